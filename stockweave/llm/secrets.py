"""Secret scans: known forms by pattern, other random-looking strings by windowed entropy.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed, each with its pattern, the group whose length counts, and its least length.
#: Runs of one class match whole or not at all, so theirs may state the least length themselves.
_FOUND = "array<struct<start:int,stop:int,text:string>>"
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: A cheap test that every text with a span of the kind passes.
HINTS = {"assign": r"(?i:pass|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}"}
#: Candidates of the entropy scan; classes by their letters, with the least entropy in bits of some window.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8))
WINDOW = 20
#: The letters of candidates.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates that are no secrets: words (letters only), paths of words, ids of zeros, separators, counters.
ALLOWED = (r"^[A-Za-z]+$", r"^[A-Za-z]+([-_/][A-Za-z]+)+$", r"^[-_=+/]+$", r"^[0-9]+$", r"^(.)\1+$")


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, text>> of a pattern's matches: starts from the lengths of what lies between them.

    What a lambda would name more than once is bound as its argument: an expression
    inside it is evaluated for every element.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    walked = F.aggregate(
        F.filter(pairs, lambda e: e["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("spans")),
        lambda s, e: F.struct(
            (s["at"] + F.length(e["gap"]) + F.length(e["hit"])).alias("at"),
            F.concat(
                s["spans"],
                F.array(F.struct((s["at"] + F.length(e["gap"])).alias("start"), (s["at"] + F.length(e["gap"]) + F.length(e["hit"])).alias("stop"), e["hit"].alias("text"))),
            ).alias("spans"),
        ),
    )
    return walked["spans"]


def _spans(text: Column, kind: str, pattern: str, hint: str, keep) -> Column:
    """array<struct<start, rank, kind, stop>> of the matches that `keep` accepts; texts without the hint are passed over."""
    rank = [*BASE, "entropy"].index(kind)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
    spans = F.transform(F.filter(_found(text, pattern), keep), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))
    return F.when(text.rlike(hint), spans).otherwise(none)


def _long_enough(pattern: str, group: int, least: int):
    return lambda s: F.length(F.regexp_extract(s["text"], pattern, group)) >= least


def window_entropy(word: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of the word's windows (of the word, if shorter); words of LETTERS, windows under 64.

    One pass: a letter entering or leaving a window moves its count c by one, and with it
    the sum of c log2 c, from which the window's entropy follows. The counts are held as
    6 bits each, ten to a number.
    """
    weight = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    place = lambda x: F.call_function("instr", F.lit(LETTERS), x) - 1
    letters = F.split(word, "")
    left = F.concat(F.array_repeat(F.lit(""), window), letters)  # what leaves the window as each letter enters
    pairs = F.filter(F.arrays_zip(letters.alias("new"), left.alias("old")), lambda e: e["new"] != "")
    steps = F.transform(pairs, lambda e, i: F.struct(place(e["new"]).alias("new"), F.when(e["old"] != "", place(e["old"])).otherwise(-1).alias("old"), (i >= window - 1).alias("full")))

    def count(counts: Column, letter: Column) -> Column:
        held = F.get(counts, F.floor(letter / 10).cast("int"))
        return F.call_function("shiftrightunsigned", held, (letter % 10 * 6).cast("int")).bitwiseAND(F.lit(63).cast("long")).cast("double")

    def moved(counts: Column, letter: Column, by: int) -> Column:
        unit = F.call_function("shiftleft", F.lit(by).cast("long"), (letter % 10 * 6).cast("int"))
        return F.transform(counts, lambda c, i: F.when(i == F.floor(letter / 10), c + unit).otherwise(c))

    def step(s: Column, e: Column) -> Column:
        leaves = e["old"] >= 0
        old = count(s["counts"], e["old"])
        fewer = F.when(leaves, moved(s["counts"], e["old"], -1)).otherwise(s["counts"])
        new = count(s["counts"], e["new"]) - F.when(leaves & (e["old"] == e["new"]), 1.0).otherwise(0.0)
        total = s["sum"] + F.when(leaves, weight(old - 1) - weight(old)).otherwise(F.lit(0.0)) + weight(new + 1) - weight(new)
        return F.struct(moved(fewer, e["new"], 1).alias("counts"), total.alias("sum"), F.when(e["full"], F.least(s["least"], total)).otherwise(s["least"]).alias("least"))

    none = F.lit([0] * (-(-len(LETTERS) // 10))).cast("array<bigint>")
    start = F.struct(none.alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("least"))
    size = F.least(F.length(word), F.lit(window)).cast("double")
    # The least sum of a full window has the largest entropy; a shorter word is one window.
    return F.when(F.length(word) > 0, F.log2(size) - F.aggregate(steps, start, step, lambda s: F.coalesce(s["least"], s["sum"])) / size).otherwise(F.lit(0.0))


def _random(word: Column) -> Column:
    """Whether an allow-list doesn't clear the candidate and a window reaches its class's entropy."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | word.rlike(pattern)
    least = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(word.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(allowed, F.lit(False)).otherwise(F.coalesce(window_entropy(word) >= least, F.lit(False)))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Every document's secrets: doc_id, text, spans array<struct<start, rank, kind, stop>> by start, then kind.

    The columns named in `keep` come along (a null text as an empty one).

    Starts and stops are code points, stop exclusive. The base kinds follow their
    patterns, leftmost matches first; kind `entropy` adds candidates of high windowed
    entropy that no allow-list clears, looked for in what the base spans leave of the text.
    Null texts are empty and have no spans; repeated rows come back each; an empty table
    gives none; columns other than the two named and those to keep are not read, whatever their names.
    """
    others = [c for c in keep if c not in (id_col, text_col, "doc_id", "text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*others, F.lit(0).alias("_")).alias("others"))
    text = F.col("text")
    for kind, (pattern, group, least) in BASE.items():
        rows = rows.withColumn(kind, _spans(text, kind, pattern, HINTS[kind], _long_enough(pattern, group, least)))
    rows = rows.withColumn("base", F.array_sort(F.concat(*BASE)))
    # Blanks stand for base spans, so that what is beside them is looked at by itself.
    rows = rows.withColumn("rest", redacted(text, F.col("base"), None))
    rows = rows.withColumn("more", _spans(F.col("rest"), "entropy", CANDIDATE, CANDIDATE, lambda s: _random(s["text"])))
    return rows.select("doc_id", "text", *(F.col("others")[c].alias(c) for c in others), F.array_sort(F.concat("base", "more")).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str | None = "[REDACTED]") -> Column:
    """The text with every span replaced by the mask, overlapping ones as one; by as many blanks, without a mask."""
    blanks = lambda n: F.repeat(F.lit(" "), n) if mask is None else F.lit(mask)
    more = lambda n: F.repeat(F.lit(" "), n) if mask is None else F.lit("")
    state = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.concat(s["out"], more(F.greatest(x["stop"] - s["at"], F.lit(0)))).alias("out"))).otherwise(
            F.struct(x["stop"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), blanks(x["stop"] - x["start"])).alias("out"))
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))).otherwise(text)
