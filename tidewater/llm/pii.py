"""Operator 3: personal data, with built-in functions only.

Regular expressions propose spans, leftmost and non-overlapping for each kind; validators (octets up to
255, digit counts, Luhn for cards, mod-97 for IBANs) drop false ones without a retry; words near a span raise
or lower its score. Offsets count code points, ends are exclusive.

The patterns match what the plain ones given in ``PLAIN`` match, but are written with possessive
quantifiers and look-behinds, so that long runs of letters or digits take linear time and no deep stack.

Defined cases: a null or empty text has no spans; a text may hold any number of spans; repeated rows give repeated results; null ids are kept;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, whole_text

#: The patterns of the four base kinds, and that of account numbers.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: A text without this string has no span of the kind.
NEEDS = {"email": "@", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Score of a confirmed span, and words that speak for a kind or against all.
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.85}
FOR_WORDS = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|login|address",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax|cell",
    "iban": "iban|account|bank|konto|cuenta|compte",
}
AGAINST_WORDS = "example|sample|version|isbn|test|serial"
NEAR = 40


def _mod97(account: Column) -> Column:
    s = F.regexp_replace(account, " ", "")
    turned = F.split(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4)), "")
    digit = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.pmod(acc * F.when(c.between("0", "9"), 10).otherwise(100) + digit(c), F.lit(97))
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & _mod97(value)
    return F.lit(True)


def _score(kind: str, before: Column, after: Column) -> Column:
    near = F.lower(F.concat_ws(" ", F.substring(before, -NEAR, NEAR), F.substring(after, 1, NEAR)))
    bonus = F.when(near.rlike(rf"\b(?:{FOR_WORDS[kind]})"), 0.15).otherwise(0.0)
    malus = F.when(near.rlike(rf"\b(?:{AGAINST_WORDS})\b"), -0.3).otherwise(0.0)
    return F.round(F.lit(BASE_SCORE[kind]) + bonus + malus, 2)


def running(lengths: Column) -> Column:
    """The running total of an array of n numbers, by blocks of about n ** 0.5, so that no long array is copied for
    each of its elements."""

    def totals(xs: Column) -> Column:
        zero = F.array().cast("array<bigint>")
        return F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))

    def by_blocks(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")
        starts = F.sequence(F.lit(1), F.size(xs), size)

        def joined(blocks: Column) -> Column:
            upto = totals(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
            return let(upto, lambda u: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.coalesce(F.get(u, i - 1), F.lit(0))))))

        return let(F.transform(starts, lambda at: totals(F.slice(xs, at, size))), joined)

    longs = lengths.cast("array<bigint>")
    return F.when(F.size(longs) <= 64, totals(longs)).otherwise(let(longs, by_blocks))


def spans_of(text: Column, kind: str) -> Column:
    """ARRAY<STRUCT<kind, start, end, value, score>> of the confirmed spans of one kind, by start.

    What stands between matches (split) and the matches (extract) come from the same scan order, so their
    lengths add up to the offsets.
    """
    pattern = PATTERNS[kind]
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>")

    def located(between: Column) -> Column:
        def with_found(found: Column) -> Column:
            lengths = F.transform(found, lambda f, i: F.char_length(F.get(between, i)) + F.char_length(f))
            made = lambda end, i: F.struct(
                F.lit(kind).alias("kind"),
                (end - F.char_length(F.get(found, i))).cast("bigint").alias("start"),
                end.cast("bigint").alias("end"),
                F.get(found, i).alias("value"),
                _score(kind, F.get(between, i), F.get(between, i + 1)).alias("score"),
            )
            return F.filter(F.transform(running(lengths), made), lambda s: confirmed(kind, s["value"]))

        extracted = F.regexp_extract_all(text, F.lit(pattern), 0)
        return F.when(F.size(between) > 1, let(extracted, with_found)).otherwise(none)

    spans = let(F.split(text, pattern, -1), located)
    if kind in NEEDS:
        spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none)
    return spans


def find(docs: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """doc_id and ``spans``, by kind in the order given and then by start, for every row of docs."""
    text = F.col("text")
    return docs.select("doc_id", whole_text().alias("text")).select(
        "doc_id", F.concat(*[spans_of(text, k) for k in kinds]).alias("spans")
    )


def mask(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first one counts."""
    inner = F.transform(
        F.array_sort(spans, lambda a, b: (a["start"] - b["start"]).cast("int")), lambda s: s
    )
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(
                acc["out"],
                F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.lit("["), s["kind"], F.lit("]"),
            ).alias("out"),
        )
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        inner,
        zero,
        step,
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))),
    )


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of find(): n_<kind>, base_sha256 over the base kinds, spans of all kinds and their scores."""
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return find(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*PLAIN))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
        F.aggregate("spans", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"),
    )
