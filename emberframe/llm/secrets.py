"""Secrets in texts: known shapes, and strings whose letters are too evenly mixed to be words. SQL expressions only."""

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import table, texts_of

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs are maximal, so asking for the length in the pattern finds what filtering all runs would.
HEX = r"[0-9a-f]{32,}"

#: Character classes of candidate strings: pattern, what it must hold, its alphabet, and the entropy in bits that a window
#: must reach. A window of 20 random hex digits has about 3.3 bits, 20 random base64 characters about 4.1, prose 3.5.
WINDOW = 20
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{20,}", ("[0-9]", "[A-Fa-f]"), "0123456789abcdef", 3.0),
    "entropy_base64": (r"[A-Za-z0-9+/_=-]{24,}", ("[0-9]", "[a-z]", "[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
}
KINDS = ("assign", "access", "hex", *CLASSES)
BASE = KINDS[:3]

#: Strings of high entropy that are no secrets: unique ids, runs of the alphabet or the digits, placeholders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)abcdefgh|01234567|12345678|qwertyui",
    r"(?i)example|placeholder|changeme|your[_-]",
)

#: Sorting structs sorts by start, then kind.
SPANS = "array<struct<start:int,kind:int,end:int,found:string>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(pattern: str, kind: int, least: str | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` in ``text`` with their places in code points. ``least`` is a
    condition on a match ``x.`1` ``, whose first group is ``x.`2` ``; what fails it is dropped after it has been matched."""
    every = _quoted(rf"(?s)(.*?)({pattern}|\z)")
    # the last match is the empty one at the end, behind the last gap
    parts = f"arrays_zip(regexp_extract_all(text, {every}, 1), regexp_extract_all(text, {every}, 2), regexp_extract_all(text, {every}, {3 if least else 2}))"
    step = f"""named_struct('at', acc.at + length(x.`0`) + length(x.`1`), 'found', IF(x.`1` = '' OR NOT ({least or "TRUE"}), acc.found,
        concat(acc.found, array(named_struct('start', acc.at + length(x.`0`), 'kind', {kind}, 'end', acc.at + length(x.`0`) + length(x.`1`), 'found', x.`1`)))))"""
    places = f"aggregate({parts}, named_struct('at', 0, 'found', CAST(array() AS {SPANS})), (acc, x) -> {step}, acc -> acc.found)"
    return F.expr(f"IF(text RLIKE {_quoted(pattern)}, {places}, CAST(array() AS {SPANS}))")


def base_spans() -> list[Column]:
    access = F.filter(matches(ACCESS, 1), lambda x: F.length(x["found"]) >= 16)
    return [matches(ASSIGN, 0, "length(x.`2`) >= 8"), access, matches(HEX, 2)]


def hot_part(kind: int, alphabet: str, bits: float) -> str:
    """SQL for the part of candidate ``x`` from its first to its last window of at least ``bits`` bits, or NULL.

    One pass over the characters. The counts of the window's characters gain the entering one and lose the leaving one, and
    so does the sum of count * log2(count), from which the entropy follows."""
    table_ = ", ".join(f"{c and c * log2(c)!r}D" for c in range(WINDOW + 2))
    codes = f"transform(split({'lower(x.found)' if kind == 3 else 'x.found'}, ''), c -> instr({_quoted(alphabet)}, c) - 1)"
    enters, leaves = "get(codes, i)", f"get(codes, i - {WINDOW})"
    f = lambda n: f"get(terms, {n})"
    c_in, c_out = f"get(acc.counts, {enters})", f"get(acc.counts, {leaves})"
    gained = f"({f(c_in + ' + 1')} - {f(c_in)})"
    total = f"""CASE WHEN i < {WINDOW} THEN acc.total + {gained} WHEN {enters} = {leaves} THEN acc.total
        ELSE acc.total + {gained} - {f(c_out)} + {f(c_out + ' - 1')} END"""
    counts = f"transform(acc.counts, (n, j) -> n + IF(j = {enters}, 1, 0) - IF(i >= {WINDOW} AND j = {leaves}, 1, 0))"
    hot = f"i >= {WINDOW - 1} AND log2({WINDOW}) - ({total}) / {WINDOW} >= {bits}D"
    step = f"""named_struct('counts', {counts}, 'total', {total},
        'first', IF(acc.first < 0 AND {hot}, i - {WINDOW - 1}, acc.first), 'last', IF({hot}, i + 1, acc.last))"""
    start = f"named_struct('counts', array_repeat(0, {len(alphabet)}), 'total', 0D, 'first', -1, 'last', -1)"
    done = f"""IF(acc.first < 0, NULL, named_struct('start', x.start + acc.first, 'kind', {kind}, 'end', x.start + acc.last, 'found', x.found))"""
    walk = f"aggregate(sequence(0, size(codes) - 1), {start}, (acc, i) -> {step}, acc -> {done})"
    # a one-element array names the codes and the table for the walk
    return f"element_at(transform(array({codes}), codes -> element_at(transform(array(array({table_})), terms -> {walk}), 1)), 1)"


def entropy_spans(kind: int) -> Column:
    pattern, holds, alphabet, bits = CLASSES[KINDS[kind]]
    each = lambda name, regexes, word: word.join(f"{name} RLIKE {_quoted(r)}" for r in regexes)
    wanted = lambda name: f"({each(name, holds, ' AND ')}) AND NOT ({each(name, ALLOWED, ' OR ')})"
    some = f"exists(regexp_extract_all(text, {_quoted(pattern)}, 0), s -> {wanted('s')})"
    # candidates are found with their places only where there are any
    return F.expr(
        f"IF({some}, filter(transform(filter(places_{kind}, x -> {wanted('x.found')}), x -> {hot_part(kind, alphabet, bits)}), x -> x IS NOT NULL), CAST(array() AS {SPANS}))"
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base`` and ``more`` to rows with ``text`` (not null): spans ``start, end, kind (number in KINDS), found``."""
    names = docs.columns
    some = docs.select("*", *[c.alias(f"base_{k}") for k, c in enumerate(base_spans())], *[_places(k).alias(f"places_{k}") for k in (3, 4)])
    ordered = lambda spans: F.sort_array(spans)
    some = some.select(*names, ordered(F.concat(*[f"base_{k}" for k in range(3)])).alias("base"), F.concat(*[entropy_spans(k) for k in (3, 4)]).alias("hot"))
    inside = lambda x: F.exists("base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))
    return some.select(*names, "base", ordered(F.filter("hot", lambda x: ~inside(x))).alias("more"))


def _places(kind: int) -> Column:
    return matches(CLASSES[KINDS[kind]][0], kind)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` (start, end, kind, found) for each row of ``docs``, by start, then kind; code points, end exclusive.

    Base kinds: assignments to secret names, access keys, long hex. Added kinds: windows of high entropy, per character
    class, unless allowed or within a base span. A null or empty text has no spans; null ids and repeated rows stay; other
    columns are not looked at; an empty table gives no rows. Nothing is shuffled: a row depends on its text alone.
    """
    found = secret_spans(texts_of(docs, doc_id, text))
    name = lambda s: F.struct(s["start"], s["end"], F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("kind"), s["found"])
    return found.select("doc_id", F.transform(F.sort_array(F.concat("base", "more")), name).alias("spans"))


def without_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``, spans that overlap by one; ``n_chars`` counted anew where
    there was a span. A null text stays null. Other columns stay as they are."""
    # a row's own columns travel in one, so that none can clash
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    step = f"""named_struct('at', greatest(acc.at, x.end), 'out', IF(x.start < acc.at, acc.out,
        concat(acc.out, substring(text, acc.at + 1, x.start - acc.at), {_quoted(mark)})))"""
    new = f"""aggregate(array_sort(concat(base, more)), named_struct('at', 0, 'out', ''), (acc, x) -> {step},
        acc -> concat(acc.out, substring(text, acc.at + 1)))"""
    changed = F.expr("size(base) + size(more) > 0")
    found = secret_spans(rows).select("row", changed.alias("changed"), F.when(changed, F.expr(new)).alias("new"))
    of = {"text": F.when(F.col("changed"), F.col("new")).otherwise(F.col("row")["text"])}
    if "n_chars" in docs.columns:
        own = F.col("row")["n_chars"]
        of["n_chars"] = F.when(F.col("changed"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(own)
    return found.select(*[of.get(n, F.col("row")[n]).alias(n) for n in docs.columns])


def op4_secret_scan(spark, sf_dir):
    """Secrets in every document: counts of the base kinds, the digest of base spans, and all spans."""
    found = secret_spans(texts_of(table(spark, sf_dir, "documents")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "more"))).alias("spans"),
    )
