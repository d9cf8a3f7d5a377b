import random
import uuid

import pytest
from pyspark.sql.group import GroupedData

from quarrylens.operators import graph

SCHEMA = "id string, entities array<struct<id:string,type:string,name:string,normalized_name:string,confidence:double>>"


@pytest.mark.parametrize("block, tile", [(2048, 128), (2048, 3), (16, 5)])
def test_rare_names_share_groups(spark, monkeypatch, tmp_path, block, tile):
    """A group for each rare name would take longer than its comparisons."""
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "TILE", tile)
    rng = random.Random(block + tile)
    often = [f"often{k}" for k in range(6)]
    sets = [{f"rare{n // 2}", f"rare{n // 2}b", *rng.sample(often, rng.randrange(4)), *rng.sample([f"r{k}" for k in range(40)], rng.randrange(3))} for n in range(400)]
    rows = [(f"a{n}", [(f"{n}{e}", "T", e, e, 0.5) for e in sorted(x)]) for n, x in enumerate(sets)]
    apply = GroupedData.applyInPandas

    def counted(self, work, schema):
        folder = str(tmp_path)

        def each(part):
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return work(part)

        return apply(self, each, schema)

    monkeypatch.setattr(GroupedData, "applyInPandas", counted)
    got = {r["article_id"]: (r["n_links"], r["best_share"]) for r in graph.shared_entities(spark.createDataFrame(rows, SCHEMA), 0.5).collect()}
    for n, x in enumerate(sets):
        close = [s for m, y in enumerate(sets) if m != n and (s := len(x & y) / len(x | y)) >= 0.5]
        assert got[f"a{n}"] == (len(close), round(max(close), 6) if close else None)
    assert block < 2048 or len(list(tmp_path.iterdir())) < 10
