"""Secret scans with DataFrame functions only: fixed patterns, and sliding-window entropy.

Patterns give the base spans.  For the added spans, candidate strings (runs of 20 characters or
more from the base-64 alphabets that have a letter and a digit) are scanned with a window: the
counts of the window's characters, a few bits each in a handful of whole numbers, and the sum of
c * log2(c) over them are kept from one position to the next, where one character leaves and one
enters, and give the window's Shannon entropy.  Candidates of hexadecimal digits and others have thresholds of their own.  A
candidate's span runs from the first window over the threshold to the end of the last.
Candidates on the allow-list (identifiers, counting sequences, one character over and over,
placeholders), and those inside a base span, are suppressed.

Positions are code points, ends exclusive.  A pattern's positions come from the pieces between
its matches: match k starts after the lengths of the pieces and matches before it.  These are
added up in two levels, runs of RUN matches and then the matches of a run, so that work is in
proportion to a text's matches.

Defined results
    null or empty text     no spans, counts 0, the hash of the empty string
    very long text         scanned whole by one task, in time proportional to its length
    ties                   spans that start together are in the order of kinds
    repeated rows          each is scanned
    null doc_id            kept, like any other value
    empty table            no rows
    other columns          ignored
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import text_column

# The patterns of the base kinds, in the order of kinds, and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the longest runs of [0-9a-f]+ with 16 characters or more are these
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
HEX_ONLY = r"^[0-9a-fA-F]+$"
WINDOW = 20
HEX_BITS, OTHER_BITS = 3.0, 3.6

# Allow-list: what such strings are when they aren't secrets.  Tried at any length: repetitions are
# possessive, so they neither go back nor nest calls.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(.)\1{7,}",
    r"(?i)0123456789|abcdefghij|qwertyuiop|987654321",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(api|key|token|secret)|xxxx",
    r"^[A-Za-z]++(?:[-_/][A-Za-z]++)*+[-_/]?[0-9]{1,4}$",
    r"^(?:[A-Za-z]{1,12}|[0-9]{1,4})(?:[-_/+=](?:[A-Za-z]{1,12}|[0-9]{1,4}))++$",
    r"^[0-9]{1,4}([-_/][0-9]{1,4}){2}",
)

RUN = 256  # matches whose lengths are added up one by one
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
_SPAN = "struct<start:bigint,ord:int,stop:bigint,body:string>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` under a name, so that it is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(items: str, zero: str, add: Callable[[str], str], join: Callable[[str, str], str], keep: str, out: str) -> str:
    """SQL for the ``out`` of every item x to ``keep``; ``total`` is what the items before it add up to.

    Arrays grow by one element at a time within a run of RUN items only, and so does the array
    of the runs' own totals.
    """
    runs = f"transform(sequence(0, (size(items) - 1) div {RUN}), n -> slice(items, n * {RUN} + 1, {RUN}))"
    starts = f"""aggregate(
        transform(runs, run -> aggregate(run, {zero}, (t, x) -> {add('t')})),
        named_struct('at', {zero}, 'out', CAST(array() AS array<bigint>)),
        (acc, t) -> named_struct('at', {join('acc.at', 't')}, 'out', concat(acc.out, array(acc.at))),
        acc -> acc.out)"""
    kept = f"""aggregate(
        run,
        named_struct('at', start, 'out', CAST(array() AS array<{_SPAN}>)),
        (acc, x) -> named_struct('at', {add('acc.at')}, 'out', {_let('total', 'acc.at', f"IF({keep}, concat(acc.out, array({out})), acc.out)")}),
        acc -> acc.out)"""
    return _let("items", items, _let("runs", runs, f"flatten(zip_with(runs, {starts}, (run, start) -> {kept}))"))


def located(pattern: str, body: str, keep: str, order: str = "0") -> str:
    """SQL for the spans (start, ord, stop, body) of a pattern that ``text`` has; keep: over a match x.whole of x.size and its x.body."""
    p = _quoted(pattern)
    whole = f"regexp_extract_all(text, {p}, 0)"
    bodies = "found" if body == "0" else f"regexp_extract_all(text, {p}, {body})"
    gaps = f"slice(split(text, {p}, -1), 1, size(found))"  # the pieces before the matches
    beside = f"zip_with({bodies}, {gaps}, (body, gap) -> named_struct('body', body, 'gap', length(gap)))"
    names = _let("found", whole, f"zip_with(found, {beside}, (whole, y) -> named_struct('whole', whole, 'body', y.body, 'gap', y.gap, 'size', length(whole)))")
    span = f"named_struct('start', total + x.gap, 'ord', {order}, 'stop', total + x.gap + x.size, 'body', x.whole)"
    return _scan(names, "0L", lambda t: f"{t} + x.gap + x.size", lambda t, u: f"{t} + {u}", keep, span)


def entropy_span(span: str, window: int, hex_bits: float, other_bits: float) -> str:
    """SQL for a candidate's span of high entropy, a struct like its own; null if there is none.

    The candidate has ``symbols``, its characters' places in the alphabet, beside its body.
    The state holds the window's count of every character of the alphabet, as many as fit in
    each whole number, and the sum of c * log2(c); a step changes two counts.
    """
    width = window.bit_length()
    per = 62 // width
    numbers = -(-len(ALPHABET) // per)
    f = lambda c: f"IF({c} > 0, {c} * log2({c}), 0D)"
    symbol = lambda i: f"{span}.symbols[{i} - 1]"
    count = lambda k: f"(shiftright(s.x.counts[{k} div {per}], {width} * CAST({k} % {per} AS INT)) & {(1 << width) - 1})"
    one = lambda k: f"IF(j = {k} div {per}, shiftleft(1L, {width} * CAST({k} % {per} AS INT)), 0L)"
    bits = f"IF({span}.body RLIKE '{HEX_ONLY}', {hex_bits}D, {other_bits}D)"
    least = f"((log2({window}) - {bits}) * {window})"  # the sum may be this large
    return f"""
      aggregate(
        sequence(1, size({span}.symbols)),
        named_struct('counts', array_repeat(0L, {numbers}), 'total', 0D, 'first', 0, 'last', 0),
        (acc, i) -> aggregate(
          array(named_struct('now', {symbol('i')}, 'old', IF(i > {window}, {symbol(f'i - {window}')}, -1), 'x', acc)),
          acc,
          (same, s) -> aggregate(
            array(named_struct(
              'counts', transform(s.x.counts, (c, j) -> c + {one('s.now')} - IF(s.old < 0, 0L, {one('greatest(s.old, 0)')})),
              'gain', IF(s.now = s.old, 0D,
                {f(f"({count('s.now')} + 1)")} - {f(count('s.now'))}
                + IF(s.old < 0, 0D, {f(f"({count('greatest(s.old, 0)')} - 1)")} - {f(count('greatest(s.old, 0)'))})))),
            same,
            (old, g) -> named_struct(
              'counts', g.counts,
              'total', old.total + g.gain,
              'first', IF(old.first = 0 AND i >= {window} AND old.total + g.gain <= {least} + 1e-9, i - {window - 1}, old.first),
              'last', IF(i >= {window} AND old.total + g.gain <= {least} + 1e-9, i, old.last)))),
        acc -> IF(acc.last = 0, NULL, named_struct(
          'start', {span}.start + acc.first - 1,
          'ord', IF({span}.body RLIKE '{HEX_ONLY}', 3, 4),
          'stop', {span}.start + acc.last,
          'body', substr({span}.body, acc.first, acc.last - acc.first + 1))))"""


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat_ws(':', array({names})[s.ord], CAST(s.start AS STRING), CAST(s.stop AS STRING))), ',')")


def secret_spans(docs: DataFrame, window: int = WINDOW, hex_bits: float = HEX_BITS, other_bits: float = OTHER_BITS) -> DataFrame:
    """doc_id and, as arrays of (start, ord, stop, body): base (patterns) and added (entropy).

    ``ord`` is the place of the span's kind in KINDS.
    """
    none = F.expr(f"CAST(array() AS array<{_SPAN}>)")
    rows = docs.select("doc_id", text_column(docs).alias("text"))

    def when_found(pattern: str, spans: str) -> Column:
        return F.when(F.col("text").rlike(pattern), F.expr(spans)).otherwise(none)

    found = rows.select(
        "doc_id",
        when_found(ASSIGN, located(ASSIGN, "2", f"length(x.body) >= {ASSIGN_LEAST}", "0")).alias("assign"),
        when_found(ACCESS, located(ACCESS, "0", f"x.size >= {ACCESS_LEAST}", "1")).alias("access"),
        when_found(HEX, located(HEX, "0", "true", "2")).alias("hex"),
        when_found(CANDIDATE, located(CANDIDATE, "0", "true", "3")).alias("candidates"),
    )
    found = found.withColumn("base", F.concat("assign", "access", "hex"))
    allowed = " OR ".join(f"c.body RLIKE {_quoted(p)}" for p in ALLOWED)
    # in order of starts, a candidate is inside a base span if one of those before it ends as late
    in_order = "array_sort(concat(base, candidates))"
    uncovered = _scan(in_order, "-1L", lambda t: f"IF(x.ord < 3, greatest({t}, x.stop), {t})", lambda t, u: f"greatest({t}, {u})", "x.ord = 3 AND total < x.stop", "x")
    open_ones = f"filter({uncovered}, c -> NOT ({allowed}))"
    spelled = f"transform({open_ones}, c -> named_struct('start', c.start, 'body', c.body, 'symbols', transform(split(c.body, ''), x -> CAST(locate(x, '{ALPHABET}') - 1 AS INT))))"
    added = f"filter(transform({spelled}, c -> {entropy_span('c', window, hex_bits, other_bits)}), s -> s IS NOT NULL)"
    return found.withColumn("added", F.when(F.size("candidates") > 0, F.expr(added)).otherwise(none))


def scanned(docs: DataFrame, **parameters) -> DataFrame:
    """Counts, the digest of the base spans, and all spans, for every row of ``docs``."""
    spans = secret_spans(docs, **parameters)
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.size("added").cast("long").alias("n_entropy"),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("concat(base, added)").alias("spans"),
    )
