"""Personal data in texts, with DataFrame and SQL functions only.

Regular expressions propose spans. Java's split() and regexp_extract_all() run the same matcher, so the gaps that the one
yields and the matches that the other yields alternate, and running sums of their lengths are the spans' places. Validators
confirm (octets, Luhn, digit counts, mod 97), words nearby, before and behind, move the score, and what reaches the threshold is returned.
The expressions are written with possessive repeats and looks to the left, so that they stay linear on long runs; each
comment names the plain form that it stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.native import bound, offsets
from tessel.llm.shared import id_and_text

#: Lengths of IBANs by country.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_SIZED = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_SIZES.items())
_KNOWN = f"(?:{'|'.join(IBAN_SIZES.values()).replace(' ', '|')})[0-9]{{2}}"

#: The plain forms are in the comments.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 13 to 19 digits: runs are taken whole, so only whole runs of that size are of interest
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # As long as the country's are, so that a word or number behind it isn't taken in; of other countries the whole run, up to a known one.
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_SIZED}|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_KNOWN})\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a confirmed match of the kind scores by itself, and words before or behind it that speak for or against it.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.8, "phone": 0.8, "iban": 0.8, "ssn": 0.4}
FOR = {
    "email": r"(?i)mail|contact|write\s+to|address", "ip": r"(?i)\bip\b|host|server|client|address", "card": r"(?i)card|visa|credit|debit|payment|expir|cvv",
    "phone": r"(?i)phone|call|tel|mobile|fax|contact", "iban": r"(?i)iban|bank|account|konto|compte|cuenta|transfer", "ssn": r"(?i)ssn|social\s+security|taxpayer|tax\s+id",
}
AGAINST = {
    "ip": r"(?i)version|release|section|build", "card": r"(?i)order|tracking|serial|part\s+n|isbn", "phone": r"(?i)serial|part\s+n|isbn",
    "iban": r"(?i)serial|part\s+n|sku|version", "ssn": r"(?i)order|invoice|part\s+n|isbn|phone|tel",
}
STEP, NEARBY, THRESHOLD = 0.3, 48, 0.6


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """From the right, every second digit is doubled (less 9 if above 9); the sum ends in 0."""
    each = F.transform(F.split(F.reverse(digits(x)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(x: Column) -> Column:
    """The first four characters go last, letters become 10 to 35, and the number leaves 1 by 97."""
    plain = F.replace(x, F.lit(" "))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97)
    return rest == 1


def octets(x: Column) -> Column:
    """Each part is at most 255, leading zeros aside."""
    plain = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def confirmed(kind: str, x: Column) -> Column:
    if kind == "ip":
        return octets(x)
    if kind == "card":
        return luhn(x)
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return mod97(x) if kind == "iban" else F.lit(True)


def spans_of(kind: str, text: Column, found: Column) -> Column:
    """Confirmed matches as (kind, start, end, score); found are the kind's matches in text."""

    def placed(gaps: Column) -> Column:
        # A match starts behind all gaps and matches before it and the gap before itself.
        sizes = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda x, g: F.length(x) + F.length(g))
        near = lambda g, h: F.struct(F.right(g, F.lit(NEARBY)).alias("before"), F.left(h, F.lit(NEARBY)).alias("behind"), F.length(g).alias("gap"))
        around = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.slice(gaps, F.lit(2), F.size(found)), near)
        starts = F.zip_with(offsets(sizes), around, lambda at, a: F.struct((at + a["gap"]).alias("start"), a["before"].alias("before"), a["behind"].alias("behind")))
        return F.zip_with(starts, found, lambda a, x: F.struct(a["start"].alias("start"), x.alias("text"), a["before"].alias("before"), a["behind"].alias("behind")))

    said = lambda x, words: F.when(x["before"].rlike(words[kind]) | x["behind"].rlike(words[kind]), STEP).otherwise(0.0) if kind in words else F.lit(0.0)
    sure = F.filter(bound(F.split(text, PATTERNS[kind], -1), placed), lambda x: confirmed(kind, x["text"]))
    scored = F.transform(sure, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), (F.lit(SCORES[kind]) + said(x, FOR) - said(x, AGAINST)).cast("double").alias("score")))
    return F.filter(scored, lambda x: F.lit(kind in BASE) | (x["score"] >= THRESHOLD))


NONE = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id and spans (kind, start, end, score), by kind as listed, then start.

    Places are code points of the whole text, ends exclusive. Null and empty texts have no spans; texts of any length are read whole, and n matches cost n to the
    power of 1.5. email, ip, card and phone are always returned once confirmed, with a score; iban and ssn need THRESHOLD after the words within NEARBY
    characters before and behind them are weighed. Spans of different kinds may overlap; of one kind the leftmost stands. Repeated rows are judged each on their
    own, an empty table gives an empty one, and other columns of docs, whatever their names, are not read.
    """
    return _with_spans(docs).drop("text")


def _with_spans(docs: DataFrame) -> DataFrame:
    texts = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    asked = {"email": F.contains(F.col("text"), F.lit("@")), "phone": F.contains(F.col("text"), F.lit("+"))}
    none = F.array().cast("array<string>")
    texts = texts.withColumns({f"_{k}": F.when(asked.get(k, F.lit(True)), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in PATTERNS.items()})
    kinds = [F.when(F.size(f"_{k}") > 0, spans_of(k, F.col("text"), F.col(f"_{k}"))).otherwise(F.array().cast(NONE)).cast(NONE) for k in PATTERNS]
    return texts.select("doc_id", "text", F.concat(*kinds).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans as kind:start:end."""
    found = find_pii(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; of spans that overlap, the first goes."""
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    done = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(F.concat(s["out"], F.substr("text", s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out"), x["end"].alias("at"))), lambda s: F.concat(s["out"], F.substr("text", s["at"] + 1)))
    return _with_spans(docs).select("doc_id", done.alias("text"))
