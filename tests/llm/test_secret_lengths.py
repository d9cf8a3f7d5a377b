import random

from quarrylens.llm import secrets


def test_allow_list_holds_at_any_length(spark):
    """Paths and names on both sides of 256 characters and far beyond; random text of the same length is found."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    texts = []
    for parts in (15, 20, 21, 22, 23, 25, 400, 40_000):
        path = "-".join(word(9) if k % 2 else str(rng.randrange(10, 99)) for k in range(parts))
        name = "/".join(word(11) for _ in range(parts)) + "-42"
        texts += [(path, True), (name, True), ("".join(rng.choice("abcdefghkmnpqrstuvwyzABCDEFGHKMNPQRSTUVWYZ23456789") for _ in range(len(path))), False)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id int, text string")
    found = {r["doc_id"]: r["n_entropy"] for r in secrets.scanned(docs).collect()}
    assert all((found[k] == 0) == allowed for k, (_, allowed) in enumerate(texts)), found
