"""Token counts, packing, WARC, I-Match and decontamination."""

import hashlib
import random
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm import decontaminate, imatch, packing, tokens, warc

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a <|endoftext|> b'll  \n\n x y", "<|endoftext|><|endoftext|>", "日本語 テキスト 　 😀 12", "tab\t\tx \x1c y\x85 z", "it's I'LL we'd", "  lead", "trail  ", "x" * 5000, "é ­​ ½", "1234567 ٣٤"]


# --- token counts ---------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokens_equal_the_library(spark, name):
    path = public_tokenizers.path(name)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs, path).collect()}
    if name.endswith(".json"):
        want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    assert [got[i] for i in range(len(texts))] == [(len(t.encode()), n) for t, n in zip(texts, want)]
    assert got[len(texts)] == (0, 0)


def test_piece_table_stays_bounded():
    c = tokens.PieceCounter(public_tokenizers.path("byte_bpe_50k.json"), most=50)
    whole = tokens.PieceCounter(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(20):
        texts = [" ".join(f"w{i}x{j}" for j in range(10))]
        assert c.count(texts) == whole.count(texts)
        assert len(c.known) <= 60


def test_tokens_of_repeated_rows_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.token_counts(docs, path).collect()) == [(0, 1), (1, 2), (1, 2)]
    assert tokens.token_counts(docs.limit(0), path).collect() == []


# --- packing --------------------------------------------------------------------------------------


def padding(bounds, lengths, counts):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted(rng.sample(range(60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        for k in (1, 2, 3):
            got = packing.boundaries(np.array(lengths), np.array(counts), k).tolist()
            best = min(padding([*c, lengths[-1]], lengths, counts) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1], n))
            assert got[-1] == lengths[-1] and len(got) <= k and padding(got, lengths, counts) == best


def test_pack_places_every_piece_once(spark):
    rng = random.Random(3)
    n = [rng.randrange(0, 700) for _ in range(500)] + [0, 1, 2048, 2049, 10_000] + [33] * 200
    rows = [(i, x, "b") for i, x in enumerate(n)] + [(7, 33, "again"), (None, 12, "n"), (8, None, "null")]
    lengths = spark.createDataFrame(rows, "doc_id long, n long, bucket string").select("doc_id", "n")
    got = packing.pack(lengths, max_length=512, buckets=6, budget=2000, shard_rows=100).collect()
    assert sum(r["length"] for r in got) == sum(x or 0 for _, x, _ in rows)
    assert len(got) == sum(max(1, -(-(x or 0) // 512)) for _, x, _ in rows)
    batches, sizes = {}, {}
    for r in got:
        assert 0 <= r["length"] <= r["padded_length"] and r["start"] == r["piece"] * 512
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
        sizes[r["bucket"]] = max(1, 2000 // max(1, r["padded_length"]))
    for (bucket, batch), slots in batches.items():
        last = max(b for k, b in batches if k == bucket)
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) == sizes[bucket] or (batch == last and len(slots) < sizes[bucket])
    bounds = sorted({r["padded_length"] for r in got})
    count = {}
    for r in got:
        count[r["length"]] = count.get(r["length"], 0) + 1
    assert sum(r["padded_length"] - r["length"] for r in got) == padding(bounds, *zip(*sorted(count.items())))
    assert packing.pack(lengths.limit(0)).collect() == []


def test_word_lengths(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " a  b\tc\n", 1), (3, "d", 1)], "doc_id long, text string, n int")
    assert sorted((r["doc_id"], r["n"]) for r in packing.word_lengths(docs).collect()) == [(1, 0), (2, 0), (3, 1), (3, 3)]


def test_packing_cuts_by_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [None, "", "a few plain words", "é" * 50_000, "".join(chr(0x4E00 + i * 7 % 2000) for i in range(9000)), "word " * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(model.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    assert want[3] > 2048 and want[4] > 2048
    import corpus_pipeline

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for got in (packing.op8_packing(spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["packing"](spark, docs, str(tmp_path))):
        rows = got.collect()
        assert {i: sum(r["length"] for r in rows if r["doc_id"] == i) for i in want} == want
        assert max(r["length"] for r in rows) <= 2048
        batches = {}
        for r in rows:
            batches[r["bucket"], r["batch"]] = batches.get((r["bucket"], r["batch"]), 0) + r["padded_length"]
        assert max(batches.values()) <= 32768


# --- WARC -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "é" * 300_000
    rows = [(5, "http://a", long), (3, None, long), (9, "http://a\r\nX: y", long), (4, "u", None), (2, "u", "short"), (1, "u", "short"), (7, "u", "b" * 100), (8, "u", "b" * 100), (8, "u", "b" * 100), (None, "u", "b" * 100)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    archived = warc.archive(pages, chunk_bytes=1000, archives=3)
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(archived).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min((j for j, _, x in rows if x == h and j is not None), default=None)
        again = len(raw) >= 100 and i is not None and i != first
        want.append((i or 0, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert max(len(r["data"]) for r in archived.collect()) <= 1000
    # The files are WARC: headers, declared lengths, two line ends.
    found = 0
    for n in range(3):
        raw = b"".join(warc.warc_file(archived, n))
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            raw, found = rest[size + 4 :], found + 1
    assert found == len(rows)
    assert warc.read(warc.archive(pages.limit(0))).collect() == []


def test_warc_matches_sql(spark):
    got = warc.op10_warc(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    cur = con.execute(warc.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, cur.fetchall()))


def test_broken_archives_are_noticed():
    head = warc.header("a", "response", "u", "0", 4, None, 1)
    good = [("a", 0, head), ("a", 1, b"ab"), ("a", 2, b"cd"), ("a", 3, warc.END)]
    assert [x[1] for x in warc.records(good)] == [4]
    for broken in (good[:-1], good[1:], [good[0], *good[2:]], [*good[:3], ("a", 3, b"xxxx")], [good[0], ("a", 1, b"abcde"), good[3]]):
        with pytest.raises(ValueError):
            list(warc.records(broken))


# --- I-Match --------------------------------------------------------------------------------------


def test_imatch_contract(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + rng.choice(["", "s", "ß", "é"])
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["", "😀 é", "!!", "x"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, texts[2]), (1000, texts[5])]
    docs = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, term string").repartition(5)
    got = imatch.fingerprints(docs, low=0.02, high=0.9).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: -r[0])
    want = sorted((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + ordered[(k + 1) % len(ordered)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(ordered))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    of = {r["doc_id"]: r for r in got}
    assert of[15]["fingerprint"] == of[1000]["fingerprint"]
    prints = {i: of[i]["fingerprint"] for i, _ in rows}
    for k, (i, t) in enumerate(ordered):
        r, nxt = of[i], ordered[(k + 1) % len(ordered)]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert i == 6 or (r["near_next"] == 1) == (prints[i] == prints[nxt[0]])  # row 6 is there twice


def test_imatch_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, None), (1, "a b c d e f" * 2000)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_chars"]): r["edited_sha256"] for r in imatch.fingerprints(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == 3 and got[(None, 0)] == sha("")
    alone = imatch.fingerprints(docs.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert imatch.fingerprints(docs.limit(0)).collect() == []


def test_imatch_has_no_python(spark):
    plan = imatch.op2_imatch_fingerprints(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_next_over_many_buckets(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 100_003).alias("i"), F.col("id").cast("string").alias("t"))
    got = {r["i"]: r["next"] for r in imatch.with_next(rows, bucket_rows=37).select("i", "next").collect()}
    data = sorted(((r["i"], r["t"]) for r in rows.collect()), reverse=True)
    assert got == {i: data[(k + 1) % len(data)][1] for k, (i, _) in enumerate(data)}


# --- decontamination ------------------------------------------------------------------------------


def test_alignment_against_plain_smith_waterman():
    rng = random.Random(5)

    def plain(a, b):
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
        return max(map(max, h))

    pairs = [([rng.randrange(1, 6) for _ in range(rng.randrange(1, 12))], [rng.randrange(1, 6) for _ in range(rng.randrange(1, 20))]) for _ in range(60)]
    tall, width = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    item, window = np.zeros((60, tall), np.uint64), np.zeros((60, width), np.uint64)
    for r, (a, b) in enumerate(pairs):
        item[r, : len(a)], window[r, : len(b)] = a, b
    best, _ = decontaminate.align(item, np.array([len(a) for a, _ in pairs]), window)
    assert np.allclose(best, [plain(a, b) for a, b in pairs])


def test_contaminated(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(30)) for _ in range(8)]
    filler = lambda n: " ".join(word() for _ in range(n))
    edit = lambda t, n: " ".join(w if i % n else word() for i, w in enumerate(t.split()))
    docs = [(i, f"{filler(rng.randrange(50))} {t} {filler(20)}") for i, t in enumerate(items)]
    docs += [(100 + i, f"{filler(30)} {edit(t, 6)} {filler(5)}") for i, t in enumerate(items)] + [(200 + i, t.upper()) for i, t in enumerate(items)]
    clean = [(1000 + i, filler(200)) for i in range(60)] + [(2000, None), (2001, ""), (2002, " ".join(items[0].split()[:4]))]
    table = spark.createDataFrame([(i, t, 0.1) for i, t in docs + clean + [(0, docs[0][1])]], "doc_id long, text string, score double").repartition(4)
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(90, None, 1), (91, "", 1), (92, "two words", 1), (None, "x y z", 1)], "item_id long, text string, doc_id int")
    got = decontaminate.contaminated(table, bench, block_bytes=600).collect()
    want = sorted([(i, i % 100) for i, _ in docs] + [(0, 0)])
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want
    assert all(r["score"] == 1 for r in got if r["doc_id"] < 100 or r["doc_id"] >= 200)
    assert decontaminate.contaminated(table, bench.limit(0)).collect() == [] and decontaminate.contaminated(table.limit(0), bench).collect() == []


def test_a_passage_in_most_documents_is_still_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("klmnopqrs") for _ in range(rng.randrange(2, 7)))
    item = " ".join(word() for _ in range(25))
    rows = [(i, f"{word()} {item} {word()}" if i % 3 else " ".join(word() for _ in range(40))) for i in range(90)]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = {r["doc_id"] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {i for i, _ in rows if i % 3}


def test_released_tasks_yield_the_same_batches():
    import pyarrow as pa

    from quarryline.llm import kernels as K

    @K.released
    def twice(batches):
        for b in batches:
            yield b
            yield b

    one = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["a"])
    assert [b.num_rows for b in twice(iter([one, one]))] == [2] * 4
    assert list(twice(iter([]))) == []
    half_read = twice(iter([one]))
    next(half_read)
    half_read.close()  # a limit above ends a task early


def test_rare_seeds_of_many_items():
    rng = np.random.default_rng(3)
    for stretch in (1, 3, 4):
        sizes = rng.integers(0, 9, 60)
        item = np.repeat(np.arange(60), sizes)
        place = np.concatenate([rng.permutation(n) for n in sizes]).astype(np.int64)
        seed = rng.integers(0, 40, len(item)).astype(np.uint64)
        order = rng.permutation(len(item))
        item, place, seed = item[order], place[order], seed[order]
        frequency = rng.integers(1, 90, len(np.unique(seed)))
        df = frequency[np.searchsorted(np.unique(seed), seed)]

        class Items:
            ids = list(range(60))

            def distinct(self):
                return np.unique(seed)

            def kept(self, keep):
                return keep

        items = Items()
        items.item, items.place, items.seed = item, place, seed
        want = df <= 10
        for i in range(60):
            own = sorted(np.flatnonzero(item == i), key=lambda k: place[k])
            for a in range(max(1, len(own) - stretch + 1)):
                if own[a : a + stretch]:
                    want[min(own[a : a + stretch], key=lambda k: (df[k], place[k]))] = True
        assert (decontaminate.rare(items, frequency, 1000, 0.0, stretch) == want).all()


def test_rows_without_payload_are_flushed():
    import pyarrow as pa

    n = 60_000
    batch = pa.record_batch({"archive": pa.array([0] * n, pa.int32()), "record_id": [f"r{i}" for i in range(n)], "url": ["u"] * n, "t": [""] * n, "digest": ["d"] * n, "refers_to": pa.array([1] * n), "page_id": pa.array(range(n))})
    sizes = [b.num_rows for b in warc._write_batches(1 << 20)(iter([batch]))]
    assert sum(sizes) == 2 * n and max(sizes) < 40_000


def test_rows_without_ids_are_dealt_to_shards(spark):
    lengths = spark.createDataFrame([(None, 7)] * 3000, "doc_id long, n long").repartition(6)
    got = packing.pack(lengths, buckets=2, budget=700, shard_rows=100)
    assert got.groupBy("bucket", "batch", "slot").count().where("count > 1").count() == 0 and got.count() == 3000
    assert sorted({(r["batch"], r["slot"]) for r in got.collect()}) == [(b, s) for b in range(30) for s in range(100)]
