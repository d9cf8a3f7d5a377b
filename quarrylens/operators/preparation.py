"""Document preparation: chunks, grouping by domain, resumable steps, merged results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .steps import delete_folder, exists, shared_folder

if TYPE_CHECKING:
    from ..sources.vector_index import VectorIndex

CHUNK, OVERLAP = 800, 100
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"\s+")


def _numbers(text: str, size: int, overlap: int) -> Column:
    """The numbers of a text's chunks; null if it has none."""
    n = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(size - overlap)), F.lit(1)).cast("int")
    return F.when(F.length(text) > 0, F.sequence(F.lit(0), n - 1))


def _place(text: str, size: int, overlap: int) -> tuple[Column, Column]:
    """Where the chunk of a row's number starts, and what it holds."""
    start = F.col("chunk") * (size - overlap)
    return start, F.substr(F.col(text), start + 1, F.lit(size))


def chunks(docs: DataFrame, id: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of at most ``size`` characters, each starting ``overlap`` before the last one's end."""
    start, body = _place(text, size, overlap)
    return docs.select(id, text, F.explode(_numbers(text, size, overlap)).alias("chunk")).select(id, "chunk", start.alias("start"), body.alias("body"))


def by_domain(docs: DataFrame, domain: str, fields: list[str]) -> DataFrame:
    """Available documents of each domain: counts, kinds and size, not the documents themselves."""
    return docs.groupBy(domain).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.concat_ws("/", *fields))).alias("kinds"), F.lit("AVAILABLE").alias("status"))


def one_plan_each(plans: DataFrame, domain: str, strict: bool = True) -> DataFrame:
    """Fan-in: ``plans`` if every domain has one; an error, or the repeated ones, otherwise."""
    counted = plans.groupBy(domain).agg(F.count("*").alias("n"))
    repeated = counted.filter("n > 1")
    if not strict:
        return repeated
    return counted.withColumn("n", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two plans for "), F.col(domain)))).otherwise(F.col("n")))


def not_yet(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return docs.join(done.select(key), key, "left_anti")


def reused(docs: DataFrame, existing: DataFrame, key: str, value: str, fresh: Column) -> DataFrame:
    """``value`` from an earlier run where there is one, else computed."""
    return docs.join(existing.select(key, F.col(value).alias("__old")), key, "left").withColumn(value, F.coalesce("__old", fresh)).drop("__old")


def conversation_context(turns: DataFrame) -> DataFrame:
    """Every turn with how many messages, and how long ones, stood before it."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.select("conv_id", "turn", "role", F.count("*").over(before).alias("n_before"), F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("chars_before"), F.last("role").over(before).alias("last_role"))


def serialized(turns: DataFrame) -> DataFrame:
    """A conversation as one text, in order of turns."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("context"))


def with_run_id(ids: Column, run: str) -> Column:
    """The run id added if it isn't there."""
    return F.array_union(F.coalesce(ids, F.array().cast("array<string>")), F.array(F.lit(run)))


def split_failures(rows: DataFrame, fault: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects with a reason."""
    marked = rows.withColumn("fault", fault)
    return marked.filter("fault IS NULL").drop("fault"), marked.filter("fault IS NOT NULL")


def branches(docs: DataFrame, domain: str, wanted: list[str], needed: str | None = None) -> dict[str, DataFrame]:
    """A frame for each wanted domain; an absent one is empty, but ``needed`` must be wanted."""
    if needed is not None and needed not in wanted:
        raise ValueError(f"{needed} is needed")
    return {d: docs.filter(F.col(domain) == d) for d in wanted}


def appended(*parts: DataFrame) -> DataFrame:
    """Partial results, concatenated."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run_stages(spark: SparkSession, request: str, start: DataFrame, stages: Sequence[Stage], upto: str | None = None) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """The last stage's rows, and for each stage whether it was there already.

    A stage's rows are written under the request's id; a stage counts once its write is complete.
    A later run of the same request takes up after the last such stage, and repeats none.
    ``upto`` ends a run early.  A run removes what its stages wrote once the next one is complete, so
    that a text is there twice at most; what earlier runs of the request returned stays.  An ``upto``
    before all that is left begins anew.
    """
    root, now, own = f"{shared_folder(spark)}/requests/{request}", start, None
    names = [name for name, _ in stages]
    names = names[: names.index(upto) + 1] if upto in names else names
    done = max((k for k, name in enumerate(names) if exists(spark, f"{root}/{name}/_SUCCESS")), default=-1)
    if done >= 0:
        now = spark.read.parquet(f"{root}/{names[done]}")
    for name, work in stages[done + 1 : len(names)]:
        path = f"{root}/{name}"
        work(now).write.mode("overwrite").option("compression", "zstd").parquet(path)
        now = spark.read.parquet(path)
        if own:
            delete_folder(spark, own)
        own = path
    return now, [(name, k <= done) for k, name in enumerate(names)]


def parsed(docs: DataFrame) -> DataFrame:
    """(id, text): what can be prepared; empty documents fail with a reason."""
    return docs.withColumn("fault", F.when(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0, "no text")).withColumn("status", F.when(F.col("fault").isNull(), "PROCESSING").otherwise("FAILED"))


def normalized(docs: DataFrame) -> DataFrame:
    """Runs of white space within lines as one space, no blank lines."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return docs.withColumn("text", F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def classified(docs: DataFrame) -> DataFrame:
    """A type by length and lines."""
    n = F.length("text")
    return docs.withColumn("type", F.when(n == 0, "EMPTY").when(n < 300, "NOTE").when(F.size(F.split("text", "\n")) > 10, "REPORT").otherwise("ARTICLE"))


def extracted(docs: DataFrame) -> DataFrame:
    """Fields with plain rules: title and amounts."""
    return docs.withColumns({"title": F.substring_index("text", "\n", 1), "n_numbers": F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0))})


def chunked(docs: DataFrame) -> DataFrame:
    """A row for each chunk; failed and empty documents keep one row without a body.  A title can be as
    long as its text, so only a document's first row has it."""
    start, body = _place("text", CHUNK, OVERLAP)
    rows = docs.select("*", F.explode_outer(_numbers("text", CHUNK, OVERLAP)).alias("chunk"))
    first = F.coalesce(F.col("chunk"), F.lit(0)) == 0
    return rows.withColumns({"title": F.when(first, F.col("title")), "start": start, "chunk_text": body}).drop("text")


def embedded(rows: DataFrame) -> DataFrame:
    """A small vector of each chunk by character classes; a stand-in for a model's vector.  The last class is
    all other characters, so that every chunk has a direction and can be indexed.  The chunk's text goes
    no further."""
    out = rows.withColumn("__left0", F.col("chunk_text"))
    for k, some in enumerate(CLASSES):  # each is looked for in what the ones before have left
        out = out.withColumn(f"__left{k + 1}", F.regexp_replace(f"__left{k}", some, ""))
    n = [*[F.length(f"__left{k}") for k in range(len(CLASSES) + 1)], F.lit(0)]
    shares = F.array(*[F.round((a - b) / F.greatest(n[0], F.lit(1)), 6) for a, b in zip(n, n[1:])])
    return out.select(*[c for c in rows.columns if c != "chunk_text"], F.when(F.col("chunk_text").isNotNull(), shares).alias("vector"))


def upserting(index: VectorIndex, kb: str) -> Stage:
    """The stage that puts chunks into a vector index: a document's points are replaced as a whole, those
    of a document that failed are removed."""

    def work(rows: DataFrame) -> DataFrame:
        points = rows.withColumns({"parent": F.col("id").cast("string"), "kb": F.lit(kb)})
        points = points.select(F.concat_ws("#", "parent", F.coalesce(F.col("chunk").cast("string"), F.lit("none"))).alias("id"), "kb", "parent", "vector")
        index.upsert(points)
        return rows

    return "upsert", work


def committed(rows: DataFrame) -> DataFrame:
    """One row for each document: INDEXED with its chunks, or FAILED with the reason."""
    out = rows.groupBy("id").agg(F.first("type").alias("type"), F.first("title", True).alias("title"), F.first("n_numbers").alias("n_numbers"), F.first("fault").alias("fault"), F.count("vector").alias("n_chunks"))
    return out.withColumn("status", F.when(F.col("fault").isNull(), "INDEXED").otherwise("FAILED"))


STAGES: tuple[Stage, ...] = (
    ("parse", parsed), ("normalize", normalized), ("classify", classified), ("extract", extracted),
    ("chunk", chunked), ("embed", embedded), ("commit", committed),
)
