"""Secret scan: fixed patterns plus character Markov models of random strings and identifiers.

Two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, are counted from labelled samples. A long token is a secret if the sum of its
log-likelihood ratios reaches ``evidence``. Everything over rows is built from column functions.

Labelled samples: random strings are hexadecimal and base-64 digests of the ids of the sampled rows
and the values that the patterns found there; ordinary identifiers are the other words of those
rows, alone and joined by underscores. ``sample`` bounds the number of rows sampled, by a hash of id.

Spans count code points, end exclusive. Defined cases: null text is empty and has no span; an empty
table gives an empty result (and a model that knows no character); repeated rows are scanned each;
spans of equal start come in the order of KINDS; a Markov span that touches a pattern's span is
dropped; other columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profila.llm.common import let

# The patterns and their kinds, in listed order.
KINDS = ("assign", "access", "hex", "markov")
KEYWORD = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
ASSIGN = KEYWORD + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LONG = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

SAMPLE = 4000
EVIDENCE = 12.0
SEED = 5
MASK = "<secret>"


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, rank, kind, end, value) of the leftmost matches of ``pattern``.

    Text between matches comes from a split by the same pattern; starts are sums of lengths.
    """
    rank = KINDS.index(kind)
    value = 2 if kind == "assign" else 0

    def located(parts: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            start = state["at"] + F.length(part["gap"])
            end = start + F.length(part["hit"])
            one = F.struct(
                start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"),
                part["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

        none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    parts = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    found = F.when(text.rlike(pattern), located(parts)).otherwise(
        F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>"))
    return F.filter(found, keep) if keep is not None else found


def _base(text: Column) -> Column:
    return F.concat(
        _spans(text, ASSIGN, "assign", lambda s: F.length(s["value"]) >= 8),
        _spans(text, ACCESS, "access", lambda s: s["end"] - s["start"] >= 16),
        _spans(text, HEX, "hex"))


def _pairs(value: Column) -> Column:
    """Numbers of the successive character pairs of ``value``; characters outside the alphabet are 0."""
    size = len(ALPHABET) + 1
    return F.transform(
        F.sequence(F.lit(1), F.length(value) - 1),
        lambda i: F.call_function("locate", F.call_function("substring", value, i, F.lit(1)), F.lit(ALPHABET)) * size
        + F.call_function("locate", F.call_function("substring", value, i + 1, F.lit(1)), F.lit(ALPHABET)))


def train(
    docs: DataFrame, sample: int = SAMPLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
) -> list[float]:
    """Log-likelihood ratio of every pair of characters (alphabet and one for all others), row by row."""
    size = len(ALPHABET) + 1
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    bound = min(1 << 30, (sample << 30) // max(docs.count(), 1))
    drawn = docs.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < bound).withColumn(
        "text", F.coalesce("text", F.lit("")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256)
    random = F.concat(
        F.array(digest, F.base64(F.unhex(digest))),
        F.transform(_base(F.col("text")), lambda s: s["value"]))
    words = F.array_distinct(F.regexp_extract_all(
        F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), HEX + "|" + ACCESS, " "), F.lit("[A-Za-z_]{3,19}"), F.lit(0)))
    joined = let(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(2)),
        lambda i: F.array_join(F.slice(w, i, F.lit(2)), "_")))
    labelled = drawn.select(F.lit(1).alias("random"), F.explode(random).alias("value")).unionByName(
        drawn.select(F.lit(0).alias("random"), F.explode(joined).alias("value")))
    counts = (
        labelled.where("length(value) > 1").select("random", F.explode(_pairs(F.col("value"))).alias("pair"))
        .groupBy("random", "pair").count().collect())
    table = [[0.0] * (size * size) for _ in range(2)]
    for r in counts:
        table[r["random"]][r["pair"]] += r["count"]
    return _ratios(table, size)


def _model(counts: list[float], size: int, weight: float = 4.0) -> list[float]:
    """P(next | char) from pair counts; rare characters lean on the frequency of the next one."""
    total = sum(counts)
    after = [(sum(counts[i::size]) + 0.5) / (total + 0.5 * size) for i in range(size)]
    out = []
    for row in range(size):
        cells = counts[row * size : (row + 1) * size]
        out += [(n + weight * f) / (sum(cells) + weight) for n, f in zip(cells, after)]
    return out


def _ratios(table: list[list[float]], size: int) -> list[float]:
    """Log of P(next | char) under the random model over that under the identifier model."""
    plain, odd = (_model(counts, size) for counts in table)
    return [round(log(a / b), 6) for a, b in zip(odd, plain)]


def _ratio(value: Column, model: list[float]) -> Column:
    scores = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    return F.aggregate(_pairs(value), F.lit(0.0), lambda s, p: s + F.get(scores, p))


def scan(
    docs: DataFrame, model: list[float], evidence: float = EVIDENCE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``spans``: per span start, rank, kind, end and value, sorted by start and kind.

    A column named ``spans`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    odd = _spans(
        text, LONG, "markov",
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (_ratio(s["value"], model) >= evidence))
    alone = let(_base(text), lambda base: F.concat(base, F.filter(odd, lambda o: ~F.exists(
        base, lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))))
    return docs.withColumn("spans", F.array_sort(alone))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame, mask: str = MASK, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets in its text replaced by ``mask``; rows without one stay as they are.

    Overlapping spans share one mask. ``length_col``, where present, follows a changed text.
    """
    text = F.col(text_col)

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(F.call_function("substring", text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], F.concat(state["out"], fresh)).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        F.col("_spans"), begin, step,
        lambda s: F.concat(s["out"], F.call_function("substring", text, s["at"] + 1, F.length(text))))
    changed = F.size("_spans") > 0
    found = scan(docs, train(docs)).withColumnRenamed("spans", "_spans")
    # The one-row explode keeps the optimiser from building the text again for its length.
    found = found.select("*", F.explode(F.array(F.when(changed, clean).otherwise(text))).alias("_text"))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("_text").alias(c))
        elif c == length_col:
            columns.append(F.when(changed, F.length("_text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return found.select(columns)
