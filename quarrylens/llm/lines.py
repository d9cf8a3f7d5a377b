"""Repeated line runs by a suffix array over line ids, built by distributed prefix doubling.

1.  A document is its sequence of lines that aren't blank; a line's id is its 64-bit hash.
    Lines that occur once break every repeated run, so only suffixes that start at a repeated
    line are sorted; the others are alone in their place of the suffix array from the start.
2.  Prefix doubling: suffixes are ranked by their first line, then by 2, ... ``min_lines``, then
    by twice as many lines in every round.  A round pairs a suffix's rank with that of the
    suffix as many lines on (one window over the document), and refines each rank by the pairs'
    order.  A rank is the number of sorted suffixes before its group.  Suffixes whose pair is
    unique have found their place and leave; those that reach their document's end keep their
    rank, for others that lead to them.  Rounds go on until every suffix is alone or at an end.
3.  Longest common prefixes: a group of equal ranks is an interval of the suffix array whose
    common prefix is the round's depth at least, and neighbours part in the first round that
    tells them apart.  The first suffix of an interval by (doc_id, place) stays; every other one
    starts a later copy that is as long as the deepest interval in which it isn't the first
    (to the document's end, where that ends before).
4.  A later copy counts if it has ``min_lines`` lines, or ``min_words`` words in fewer lines.
    The lines of later copies are deleted; copies that overlap or touch are one maximal run.

Groups are aggregated before they are ranked; joins that attach ranks are split by adaptive skew
handling; running counts have two levels.

Defined results
    null or empty text       no lines, unchanged
    blank lines              belong to no run; they stay unless every other line goes
    repeated rows            the later ones lose all their lines (of runs that count)
    null doc_id              ordered after all others
    ties                     rows of one doc_id are in order of a hash of their text; equal rows of
                             one doc_id give the same rows whichever is first
    very long text           its lines are rows like any others; one line is held whole
    empty table              no rows
    other columns            kept by ``without_repeats``; ignored otherwise.  Names that begin
                             with two underscores are reserved
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ._spark import bucketed, level_size, running_total, text_bytes, text_column, written

MIN_LINES, MIN_WORDS = 3, 50
CHUNK_ROWS = 512
FEW = 1 << 20  # rows whose running counts need no second level
END = -1  # the rank past a document's end
WORD = r"[^\x20\x09-\x0D]+"


def _first():
    """The order of suffixes within an interval: the least is the one that stays."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key", "row", "i"))


def _ranked(pairs: DataFrame, rows: int, total: int) -> DataFrame:
    """rank, r, r2 and the first suffix of each pair that occurs more than once; there are ``rows`` pairs
    at most, and ranks under ``total``."""
    groups = pairs.groupBy("r", "r2").agg(F.count("*").alias("n"), _first().alias("first"))
    if rows <= FEW:  # one task may hold them
        inner = Window.partitionBy("r").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.withColumn("smaller", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    else:
        width = max(1, total // level_size(total))
        groups = groups.withColumn("bucket", F.floor(F.col("r2") / F.lit(width)).cast("long"))
        groups = running_total(groups, ["r"], "bucket", ["r2"], "n", "smaller")
    return groups.filter("n > 1").select("r", "r2", (F.col("r") + F.col("smaller")).alias("rank"), "first")


_SUFFIX = ("row", "doc_id", "key", "i", "words", "n_lines")


def _refined(suffixes: DataFrame, step: int, depth: int, rows: int, total: int) -> DataFrame:
    """Suffixes, tied in ``depth`` lines, ranked by ``step`` more lines.

    Those in no interval any more are left out; those that end before ``depth`` lines, and so
    have been compared to the end, are in their place already.
    """
    ahead = Window.partitionBy("row").orderBy("i").rangeBetween(step, step)
    pairs = suffixes.withColumn("r2", F.when(F.col("i") + step >= F.col("n_lines"), END).otherwise(F.max("r").over(ahead)))
    pairs = pairs.withColumn("done", F.col("i") + depth > F.col("n_lines"))
    open_ones = pairs.filter("NOT done AND r2 IS NOT NULL").select(*_SUFFIX, "r", "r2")  # null: a unique suffix lies there
    found = open_ones.join(_ranked(open_ones, rows, total), ["r", "r2"]).select(*_SUFFIX, F.col("rank").alias("r"), "first", F.lit(False).alias("done"))
    return found.unionByName(pairs.filter("done").select(*_SUFFIX, "r", F.lit(None).cast(found.schema["first"].dataType).alias("first"), "done"))


def _later(suffixes: DataFrame, depth: int, counts) -> DataFrame:
    """row, i and end of the later copies of this round: [i, end) is their longest prefix so far."""
    later = suffixes.filter(((F.col("first.row") != F.col("row")) | (F.col("first.i") != F.col("i"))) & counts)
    return later.select("row", "i", F.least(F.col("i") + depth, F.col("n_lines")).alias("end"))


def _counted(df: DataFrame, name: str, *more) -> tuple[DataFrame, dict]:
    """``df`` written, and its number of rows ``n``, counted on the way."""
    seen = Observation()
    out = written(df.observe(seen, F.count("*").alias("n"), *more), name)
    return out, seen.get


def line_copies(numbered: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """row, and ``flags``: whether each line is one of a later copy, for rows that have some.

    ``numbered`` has a unique number ``row``, doc_id and text.
    """
    words = f"CAST(regexp_count(x, r'{WORD}') AS INT)" if min_words else "0"
    lines = F.expr(f"filter(transform(split(text, '\\n', -1), (x, j) -> named_struct('j', j, 'id', xxhash64(x), 'words', {words}, 'blank', trim(translate(x, '\\t\\r', '  ')) = '')), x -> NOT x.blank)")
    every = numbered.select("row", "doc_id", text_column(numbered).alias("text")).select("row", "doc_id", F.xxhash64("text").alias("key"), lines.alias("lines"))
    every = every.select("row", "doc_id", "key", F.size("lines").alias("n_lines"), F.posexplode(F.expr("transform(lines, (x, i) -> named_struct('j', x.j, 'id', x.id, 'words', array(x.words, x.words + coalesce(get(lines, i + 1).words, 0))))")).alias("i", "line"))
    every = every.select("row", "doc_id", "key", "n_lines", "i", "line.j", "line.id", "line.words")  # words of this line, of this and the next
    every, seen = _counted(every, "lines-all")
    total = seen["n"]

    # rank by one line: the order of line ids
    ids = every.groupBy("id").agg(F.count("*").alias("n"), _first().alias("first")).filter("n > 1")
    buckets = level_size(total)
    ids = ids.withColumn("bucket", F.shiftright((F.shiftrightunsigned(F.col("id").bitwiseXOR(F.lit(-(1 << 63))), 32)) * buckets, 32))
    ids = running_total(ids, [], "bucket", [F.col("id")], "n", "r").select("id", "r", "first")
    suffixes = every.join(ids, "id").select(*_SUFFIX, "r", "first", F.lit(False).alias("done"))

    copies, depth = None, 1
    while True:
        suffixes, seen = _counted(suffixes, "lines-suffixes", F.count_if(F.col("i") + depth <= F.col("n_lines")).alias("open"))
        if depth >= min_lines:
            counts = F.col("i") + min_lines <= F.col("n_lines")
        elif min_words and depth <= 2:
            counts = (F.col("words")[depth - 1] >= min_words) & (F.col("i") + depth <= F.col("n_lines"))
        else:
            counts = F.lit(False)
        found = _later(suffixes, depth, counts)
        copies = found if copies is None else copies.unionByName(found)
        if depth >= min_lines and not seen["open"]:
            break
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        suffixes = _refined(suffixes, step, depth, seen["n"], total)
        depth += step
    reach = written(copies.groupBy("row", "i").agg(F.max("end").alias("end")), "lines-reach")
    # one flag for each line of these documents; blank lines stand between the others
    marked = every.join(reach.select("row").distinct(), "row").join(reach, ["row", "i"], "left")
    by_line = Window.partitionBy("row").orderBy("i")
    gone = F.coalesce(F.max("end").over(by_line.rowsBetween(Window.unboundedPreceding, 0)) > F.col("i"), F.lit(False))
    before = F.coalesce(F.lag("j").over(by_line), F.lit(-1))
    marked = marked.select("row", "n_lines", F.struct("j", (F.col("j") - before - 1).alias("blank"), gone.alias("gone")).alias("line"))
    flags = F.flatten(F.transform(F.sort_array(F.collect_list("line")), lambda s: F.concat(F.array_repeat(F.lit(False), s["blank"]), F.array(s["gone"]))))
    return marked.groupBy("row").agg(flags.alias("flags"), F.count_if("line.gone").alias("n_removed"), F.first("n_lines").alias("n_lines"))


def _with_flags(docs: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """``docs`` with __flags, and __whole: every line that isn't blank goes (null: no line does).

    Documents are numbered and written as a table bucketed by runs of CHUNK_ROWS numbers; what
    is found out about them goes back to their bucket, so that no text is moved.
    """
    row = F.monotonically_increasing_id()
    numbered = docs.withColumn("__row", row).withColumn("__chunk", F.floor(F.col("__row") / F.lit(CHUNK_ROWS)).cast("long"))
    numbered = bucketed(numbered, "__chunk", "lines", text_bytes(docs))
    copies = line_copies(numbered.select(F.col("__row").alias("row"), "doc_id", "text"), min_lines, min_words)
    found = copies.select(F.floor(F.col("row") / F.lit(CHUNK_ROWS)).cast("long").alias("__chunk"), F.struct("row", "flags", (F.col("n_removed") == F.col("n_lines")).alias("whole")).alias("found"))
    found = written(found.groupBy("__chunk").agg(F.collect_list("found").alias("__found")), "lines-copies")  # of CHUNK_ROWS documents
    own = F.get(F.filter("__found", lambda x: x["row"] == F.col("__row")), F.lit(0))
    return numbered.join(found, "__chunk", "left").select(*docs.columns, own.alias("__own")).select(*docs.columns, F.col("__own.flags").alias("__flags"), F.col("__own.whole").alias("__whole"))


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, runs of removed lines and the text that is left.

    ``runs`` are [first line, end) pairs of line numbers, blank lines counted.
    """
    both = _with_flags(docs.select("doc_id", "text"), min_lines, min_words)
    text = text_column(both)
    kept = F.expr("array_join(filter(split(coalesce(CAST(text AS STRING), ''), '\\n', -1), (x, j) -> NOT coalesce(get(__flags, j), false)), '\\n')")
    begin = F.expr("filter(sequence(0, size(__flags) - 1), j -> __flags[j] AND NOT coalesce(get(__flags, j - 1), false))")
    end = F.expr("filter(sequence(0, size(__flags) - 1), j -> __flags[j] AND NOT coalesce(get(__flags, j + 1), false))")
    n_lines = F.expr("size(filter(split(coalesce(CAST(text AS STRING), ''), '\\n', -1), x -> trim(translate(x, '\\t\\r', '  ')) <> ''))")
    none = F.col("__flags").isNull()
    return both.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size(F.filter("__flags", lambda x: x))).cast("long").alias("n_removed"),
        F.when(none, F.array().cast("array<array<int>>")).otherwise(F.zip_with(begin, end, lambda a, b: F.array(a, b + 1))).alias("runs"),
        F.when(none, text).when(F.col("__whole"), "").otherwise(kept).alias("kept_text"),
    )


def without_repeats(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines of later copies; documents that lose every line go.

    All columns stay; ``text`` is what is left and ``n_chars``, if there, its length.
    """
    both = _with_flags(docs, min_lines, min_words).filter("__whole IS NULL OR NOT __whole")
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, j) -> NOT coalesce(get(__flags, j), false)), '\\n')")
    both = both.withColumn("text", F.when(F.col("__flags").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col("__flags").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return both.select(*docs.columns)
