"""The catalogue source with a client that needs no network."""

import pytest

from quarryline.sources import catalogue


def test_source(spark):
    spark.dataSource.register(catalogue.CatalogueSource)
    rows = spark.read.format("catalogue").option("client", "tests.fake_catalogue:make").option("pages", 4).load().collect()
    assert len(rows) == 12 and {r["page"] for r in rows} == {0, 1, 2, 3}
    of = {r["id"]: r for r in rows}
    assert of["d1-0"]["raw_description"].count("\n") == 39 and of["d1-1"]["raw_description"] == "longer" and of["d1-2"]["raw_description"] == "short"
    assert of["d1-1"]["license"] == "mit" and of["d1-2"]["license"] is None and of["d1-1"]["tags"] == ["a", "1"]


def test_retry():
    waits, left = [], [429, 503, None]

    def call():
        status = left.pop(0)
        if status:
            raise catalogue.StatusError(status)
        return "ok"

    assert catalogue.with_retry(call, waits.append) == "ok"
    assert 30 <= waits[0] <= 35 and 60 <= waits[1] <= 65
    for status, error in ((404, catalogue.StatusError), (500, RuntimeError)):
        waits = []

        def failing(status=status):
            raise catalogue.StatusError(status)

        with pytest.raises(error):
            catalogue.with_retry(failing, waits.append)
        assert len(waits) == (0 if status == 404 else 12) and all(w <= 605 for w in waits)
