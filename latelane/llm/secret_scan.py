"""Secrets in texts: fixed patterns, and strings that look drawn at random by two character models.

The patterns (an assignment, an access key, a long hexadecimal run) give the base spans.  Beside
them every run of key characters is scored by two Markov models of the next character: one fitted
on labelled random strings, the values that the patterns found, one on ordinary identifiers, the
other words of the corpus.  A run whose log-likelihood ratio is high enough is a secret as well.

All of it is DataFrame work.  Texts are read once, in place; only what the patterns and the run of
key characters cut out of them is stored and scored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latelane.session import materialise

# Fixed patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: The words of :data:`ASSIGN`, of which a text must hold one.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Characters of an assigned value at least.
LEAST_VALUE = 6
#: A run of key characters: both other patterns, and every candidate of the models, lie in one.
RUN = "[A-Za-z0-9+/_=-]{16,}"
#: An ordinary identifier or word that trains the second model.
WORD = "[A-Za-z0-9+/_=-]{4,}"
#: Assigned values of fewer characters (names, words) do not train the model of random strings.
LEAST_RANDOM = 16
#: The second model is fitted on the words of about this many documents, drawn by a hash.
SAMPLE_DOCS = 20_000
#: Characters of the alphabet, with one for the start.
ALPHABET = 68
#: Counts with which a character's share anywhere enters its share after another.
DRAWN = 8.0
#: A run is a secret from this log-likelihood ratio on, in thousandths of a nat.
LEAST_RATIO = 10_000
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")

_BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_totals(numbers: Column) -> Column:
    """0 and the sums of the first 1, 2, ... entries of an array.  By blocks: a long array costs its length times ``_BLOCK``, not its square."""
    sums = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda t, n: F.concat(t, F.array(F.element_at(t, -1) + n)))
    inside = lambda x: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(x) / _BLOCK).cast("int")), lambda b: sums(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK)))
    )
    return _let(numbers, lambda x: _let(inside(x), lambda blocks: _let(
        sums(F.transform(blocks, lambda s: F.element_at(s, -1))),
        lambda offsets: F.flatten(F.transform(blocks, lambda s, b: F.transform(F.slice(s, 1, _BLOCK), lambda n: n + F.get(offsets, b)))),
    )))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end, match and ``group`` of the match (``value``) of each leftmost non-overlapping match, in code points.

    The pieces between the matches and the matches give the places.
    """

    def spans(pieces: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), 0)
        values = F.regexp_extract_all(text, F.lit(pattern), group)
        sizes = lambda f: F.transform(f, lambda m, i: F.char_length(F.get(pieces, i)) + F.char_length(m))
        return _let(F.struct(found.alias("f"), values.alias("v")), lambda fv: _let(running_totals(sizes(fv["f"])), lambda ends: F.transform(
            fv["f"], lambda m, i: F.struct(
                (F.get(ends, i) + F.char_length(F.get(pieces, i))).alias("start"), F.get(ends, i + 1).alias("end"),
                m.alias("match"), F.get(fv["v"], i).alias("value"),
            ))))

    nothing = F.array().cast("array<struct<start:int,end:int,match:string,value:string>>")
    return _let(F.split(text, pattern, -1), lambda pieces: F.when(F.size(pieces) > 1, spans(pieces)).otherwise(nothing))


def _spans(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), m["value"].alias("value")
    ))


def extracted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``base`` (spans of the three patterns) and ``runs`` (candidates outside of them)."""
    df = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    lower = F.lower("text")
    holds = lower.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        holds = holds | lower.contains(word)
    df = df.withColumns({"assigned": F.when(holds, located(F.col("text"), ASSIGN, 2)), "runs": located(F.col("text"), RUN)})
    # Access keys and hexadecimal runs lie in runs of key characters: a text without such a run is not searched for them.
    searched = {
        kind: F.when(F.exists("runs", lambda r: r["match"].rlike(pattern)), located(F.col("text"), pattern))
        for kind, pattern in (("access", ACCESS), ("hex", HEX))
    }
    df = df.withColumns(searched)
    assigned = F.filter("assigned", lambda m: F.char_length(m["value"]) >= LEAST_VALUE)
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    parts = [F.coalesce(_spans(m, kind), nothing) for m, kind in ((assigned, "assign"), (F.col("access"), "access"), (F.col("hex"), "hex"))]
    df = df.select("doc_id", F.array_sort(F.concat(*parts)).alias("base"), "runs")
    return df.select("doc_id", "base", _apart(F.col("runs"), F.col("base")).alias("runs"))


def _apart(runs: Column, base: Column) -> Column:
    """The runs that overlap no base span."""
    return F.when(F.size(base) == 0, runs).otherwise(
        F.filter(runs, lambda r: ~F.exists(base, lambda s: (s["start"] < r["end"]) & (s["end"] > r["start"])))
    )


def random_samples(stored: DataFrame) -> DataFrame:
    """The distinct values of the base spans that are long enough: labelled random strings."""
    values = stored.filter(F.size("base") > 0).select(F.explode("base.value").alias("token"))
    return values.filter(F.char_length("token") >= LEAST_RANDOM).distinct()


def identifier_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE_DOCS) -> DataFrame:
    """The distinct words, with a letter and outside of all patterns, of about ``most`` documents: labelled ordinary identifiers.

    A word as long as a candidate is taken only if texts that differ have it: what stands in one text may be a secret itself.
    A document is drawn by a hash of its key and text, so the draw repeats and does not depend on the partitions.
    """
    df = docs.select(F.col(f"`{key}`").cast("string").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    n = df.count()
    if n > most:
        drawn = F.conv(F.substring(F.md5(F.concat(F.coalesce("k", F.lit("")), F.lit("|"), F.col("text"))), 1, 8), 16, 10).cast("double")
        df = df.filter(drawn * n < 2.0**32 * most)
    without = F.regexp_replace("text", ASSIGN, " ")
    words = df.select(F.xxhash64("text").alias("h"), F.explode(F.regexp_extract_all(without, F.lit(WORD), 0)).alias("token"))
    words = words.groupBy("token").agg((F.min("h") != F.max("h")).alias("shared"))
    ordinary = F.col("shared") | (F.char_length("token") < LEAST_RANDOM)
    return words.filter(ordinary & F.col("token").rlike("[A-Za-z]") & ~F.col("token").rlike(f"{ACCESS}|{HEX}")).select("token")


def bigram_counts(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """``pair`` (128 * character before, 0 at the start, + character), ``in_random``, ``in_ordinary``."""
    labelled = random.select("token", F.lit(1).alias("r")).unionByName(ordinary.select("token", F.lit(0).alias("r")))
    chars = labelled.select("r", F.transform(F.split("token", ""), lambda c: F.ascii(c)).alias("c"))
    pairs = chars.select("r", F.explode(F.transform(F.col("c"), lambda x, i: F.coalesce(F.get("c", i - 1), F.lit(0)) * 128 + x)).alias("pair"))
    return pairs.groupBy("pair").agg(F.sum("r").alias("in_random"), F.sum(1 - F.col("r")).alias("in_ordinary"))


def log_ratios(counts: DataFrame) -> list[int]:
    """Per pair the thousandths of a nat by which it is likelier in a random string.

    A model's share of a character after another is its count there, drawn towards the character's share anywhere with the
    weight of ``DRAWN`` counts.  At most one row per two characters reaches the driver.
    """
    rows = counts.collect()
    pair, before, alone = {}, {}, {}
    for r in rows:
        own = r["in_random"], r["in_ordinary"]
        pair[r["pair"]] = own
        for total, at in ((before, r["pair"] // 128), (alone, r["pair"] % 128)):
            total[at] = tuple(x + y for x, y in zip(total.get(at, (0, 0)), own))
    whole = [sum(x[i] for x in alone.values()) for i in (0, 1)]
    table = []
    for b in range(128):
        for c in range(128):
            share = []
            for i in (0, 1):
                anywhere = (alone.get(c, (0, 0))[i] + 0.5) / (whole[i] + 0.5 * ALPHABET)
                share.append((pair.get(128 * b + c, (0, 0))[i] + DRAWN * anywhere) / (before.get(b, (0, 0))[i] + DRAWN))
            table.append(math.floor(1000 * (math.log(share[0]) - math.log(share[1]))))
    return table


def ratio(token: Column, table: list[int]) -> Column:
    """The log-likelihood ratio of a token under a table of :func:`log_ratios`."""
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(codes, F.lit(1), F.size(codes) - 1)), codes, lambda a, b: a * 128 + b)
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda t, p: t + F.get(ratios, p))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_RATIO) -> DataFrame:
    """All secrets of every document: ``key`` and ``spans``, an array of (start, kind, end, value) in code points, end exclusive.

    ``kind`` is a place in :data:`KINDS`.  Spans go by start, then kind.  Null and empty texts have none.  Every row of
    ``docs`` gives one row, also where keys repeat or are null; an empty table gives none.  Without labelled samples both
    models are alike and nothing is added to the patterns' spans.  Other columns, whatever their names, are not read.
    """
    stored = materialise(extracted(docs, key, text), "secret_runs")
    table = log_ratios(bigram_counts(random_samples(stored), identifier_samples(docs, key, text)))
    likely = lambda r: r["match"].rlike("[A-Za-z]") & (ratio(r["match"], table) >= least)
    added = _spans(F.filter("runs", likely), "random")
    return stored.select(F.col("doc_id").alias(key), F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
