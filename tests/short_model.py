"""An embedding model that loses a text, for the tests."""

from vitaloom.operators.backends import embedding_model


@embedding_model("tests.short_model:short", 2)
def short(texts, kind):
    return [[0.0, 1.0] for _ in texts[1:]]
