"""A catalogue without a network: busy once, one branch missing, one record without details."""

from quarryline.sources.catalogue import StatusError


class Client:
    def page(self, number):
        return [{"id": f"d{number}-{i}", "title": f"T{i}", "description": "short", "tags": ["a", 1]} for i in range(3)]

    def detail(self, ident):
        if ident.endswith("2"):
            raise StatusError(404)
        return {"license": "mit", "description": "longer"}

    def readme(self, ident, branch):
        if branch == "main":
            raise StatusError(404)
        return "line\n" * 60 if ident.endswith("0") else " "


def make():
    return Client()
