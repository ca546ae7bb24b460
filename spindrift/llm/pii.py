"""Personal data by DataFrame functions alone.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for
IBANs), and words nearby adjust the score of those kinds that a pattern alone
doesn't settle.  Positions are code points, end exclusive.  No step runs Python, and
each document is worked on where it is read: there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:long,rank:int,end:long,kind:string,score:double>>"
#: Code points in a piece of a text: a place in it is found by its piece, and not by reading up to it.
PIECE = 256


@dataclass(frozen=True)
class Kind:
    """A kind of span: pattern, what a text must hold for it (a cheap filter), a check of the match, and its scoring.

    Patterns are possessive and start only where a run starts or the last match ended, so a
    long run of their characters is read once; they find what the plain forms find.
    """

    name: str
    pattern: str
    needs: str
    base: float
    check: str = ""
    words: str = ""
    lift: float = 0.0
    #: Code points that a match takes; what the pattern's group sees ahead of it is the span, and other spans may begin inside it. 0: the match is the span.
    head: int = 0


_W = "A-Za-z0-9._%+-"
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", rf"(?:\G|(?<![{_W}]))[{_W}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]", 0.7, "octets", "ip|host|server|address", 0.2),
    # [0-9]([\x20-]?[0-9])+ of 12 to 19 digits: the whole run, or none of it
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", "[0-9]", 0.7, "luhn", "card|visa|credit|debit|payment", 0.2),
    # \+[0-9][\x20().0-9-]+[0-9], 9 to 15 digits
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "\\+[0-9]", 0.7, "phone", "phone|tel|call|mobile|fax", 0.2),
    # a head, and ahead of it the longest run of groups; which of them belong to it is for mod97 to say
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+(?![A-Za-z0-9])|(?: [A-Z0-9]{4}(?![A-Za-z0-9])){2,7}+(?: [A-Z0-9]{1,3}(?![A-Za-z0-9]))?)))[A-Z]{2}[0-9]{2}",
        "[A-Z]{2}[0-9]{2}",
        0.8,
        "mod97",
        "iban|bank|account|konto|compte|cuenta",
        0.15,
        4,
    ),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.4, "", "ssn|social|security|taxpayer", 0.5),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,128}+(?![A-Za-z0-9])", "[A-Fa-f0-9]{16}", 0.3, "", "token|secret|password|passwd|api.?key|auth", 0.6),
)
BASE = 4
#: Code points in front of a span, and behind it, in which its words count.
WINDOW = 40
#: Base kinds always stay; others need this score.
THRESHOLD = 0.5


def _valid(check: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if check == "octets":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if check == "luhn":
        return F.call_function("luhn_check", digits)
    if check == "phone":
        return F.length(digits).between(9, 15)
    if check == "mod97":
        compact = F.replace(match, F.lit(" "), F.lit(""))
        turned = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
        # a letter counts as two digits, A being 10
        step = lambda acc, c: F.when(
            c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97
        ).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
        return F.length(compact).between(15, 34) & (F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), step) == 1)
    return F.lit(True)


def _longest(check: str, match: Column) -> Column:
    """The longest run of a match's blank-separated groups, from the first on, that passes the check; null if none does."""
    groups = F.split(match, " ")
    runs = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    return F.try_element_at(F.filter(runs, lambda run: _valid(check, run)), F.lit(1))


def _once(value: Column, use) -> Column:
    """use(value), the value made once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(items: Column, state: Column, none: Column, step) -> Column:
    """Rows that step makes of items in order: step(state, item) gives the next state and an array of rows; none is an empty one.

    An array grows by copying, so items are folded in blocks of about the root of their number, and only those
    blocks' rows are joined: a text with very many spans stays far from the square of their number.
    """
    last = lambda x: F.floor(F.sqrt(F.size(x))).cast("int")
    width = lambda x: F.ceil((F.size(x) + 1) / (last(x) + 1)).cast("int")
    blocks = _once(items, lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda n: F.slice(x, n * width(x) + 1, width(x))))

    def one(acc, item):
        then, rows = step(acc["state"], item)
        return F.struct(then.alias("state"), F.concat(acc["rows"], rows).alias("rows"))

    def block(acc, own):
        done = F.aggregate(own, F.struct(acc["state"].alias("state"), none.alias("rows")), one)
        return _once(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["parts"], F.array(d["rows"])).alias("parts")))

    start = F.struct(state.alias("state"), F.slice(F.array(none), 2, 1).alias("parts"))
    return F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["parts"]))


def _cut(pieces: Column, start: Column, length: Column) -> Column:
    """A part of a text by its pieces of PIECE code points each."""
    first, last = F.floor(start / PIECE), F.floor((start + F.greatest(length, F.lit(1)) - 1) / PIECE)
    some = F.transform(F.sequence(first, last), lambda n: F.coalesce(F.try_element_at(pieces, (n + 1).cast("int")), F.lit("")))
    return F.substr(F.array_join(some, ""), (start - first * PIECE + 1).cast("int"), length.cast("int"))


def _apart(spans: Column, none: Column) -> Column:
    """Spans in order without those that begin inside an earlier one."""

    def step(end, s):
        free = s["start"] >= end
        return F.when(free, s["end"]).otherwise(end), F.when(free, F.array(s)).otherwise(none)

    return _folded(spans, F.lit(0).cast("long"), none, step)


def _spans(kind: Kind, rank: int, pieces: Column, gaps: Column, matches: Column) -> Column:
    """Spans of a kind, out of the texts between its matches and the matches."""
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), matches.alias("m"))
    none = F.array().cast("array<struct<start:long,end:long,m:string>>")

    def step(at, p):
        start = at + F.length(p["g"])
        end = start + F.length(p["m"])
        return start + kind.head if kind.head else end, F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("m")))

    found = _folded(pairs, F.lit(0).cast("long"), none, step)
    if kind.head:
        kept = F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(_longest(kind.check, s["m"]))).cast("long").alias("end"), _longest(kind.check, s["m"]).alias("m")))
        found = _apart(F.filter(kept, lambda s: s["m"].isNotNull()), none)
    elif kind.check:
        found = F.filter(found, lambda s: _valid(kind.check, s["m"]))
    if kind.words:
        before = lambda s: _cut(pieces, F.greatest(s["start"] - WINDOW, F.lit(0)), F.least(s["start"], F.lit(WINDOW)))
        near = lambda s: F.lower(F.concat(before(s), F.lit("\n"), _cut(pieces, s["end"], F.lit(WINDOW))))
        score = lambda s: F.lit(kind.base) + F.when(near(s).rlike(rf"(?:^|[^a-z])(?:{kind.words})"), kind.lift).otherwise(0.0)
    else:
        score = lambda s: F.lit(kind.base)
    out = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), score(s).cast("double").alias("score")))
    return out if rank < BASE else F.filter(out, lambda s: s["score"] >= THRESHOLD)


def find_spans(docs: DataFrame, *keep: str, pieces: bool = False) -> DataFrame:
    """doc_id, text (null as empty), spans by start and kind, and the columns named in keep.

    A span's score is its kind's own and what words nearby add; kinds beyond the base ones need THRESHOLD.  Rows
    without a doc_id are worked on as others.  Kinds are found apart, so spans of two kinds may overlap.  Texts without what a kind needs
    cost one scan for it.  Empty texts have no spans; repeated rows stay repeated; an empty table
    gives an empty result; other columns are not read.
    """
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    # one flag for all digit kinds spares most texts six scans
    frame = frame.withColumn("_digit", text.rlike("[0-9]")).withColumn("_at", F.contains(text, F.lit("@")))
    parts = []
    for kind in KINDS:
        may = F.col("_at") if kind.needs == "@" else F.col("_digit") & text.rlike(kind.needs)
        parts.append(F.when(may, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1 if kind.head else 0))).alias(f"_m_{kind.name}"))
    frame = frame.select("*", *parts)
    gaps = [F.when(F.size(f"_m_{k.name}") > 0, F.split(text, k.pattern, -1)).alias(f"_g_{k.name}") for k in KINDS]
    frame = frame.select("*", *gaps)
    any_match = F.greatest(*(F.coalesce(F.size(f"_m_{k.name}"), F.lit(0)) for k in KINDS)) > 0
    frame = frame.select("*", F.when(any_match, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("_pieces"))
    found = [F.when(F.size(f"_m_{k.name}") > 0, _spans(k, n, F.col("_pieces"), F.col(f"_g_{k.name}"), F.col(f"_m_{k.name}"))) for n, k in enumerate(KINDS)]
    some = [F.coalesce(x, F.array().cast(SPANS)) for x in found]
    return frame.select("doc_id", *keep, "text", F.array_sort(F.concat(*some)).alias("spans"), *(["_pieces"] if pieces else []))


def _tops(spans: Column) -> Column:
    """Spans to mask: by start, those that begin inside an earlier one joined to it."""
    row = "struct<start:long,end:long,kind:string,past:long>"
    # past: where all spans in front of this one have ended
    step = lambda past, s: (F.greatest(past, s["end"]), F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), past.alias("past"))))
    heads = F.filter(_folded(spans, F.lit(0).cast("long"), F.array().cast(f"array<{row}>"), step), lambda s: s["start"] >= s["past"])
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    ends = lambda h: F.concat(F.slice(F.transform(h, lambda s: s["past"]), F.lit(2), F.size(h)), F.array(last))
    joined = lambda h: F.zip_with(h, ends(h), lambda s, end: F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"), s["past"].alias("past")))
    return _once(heads, joined)


def redact(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text with each span replaced by its kind in brackets, n_spans, and the columns named in keep; as find_spans else."""
    found = find_spans(docs, *keep, pieces=True).withColumn("_tops", F.when(F.size("spans") > 0, _tops(F.col("spans"))))
    pieces, text, tops = F.col("_pieces"), F.col("text"), F.col("_tops")
    masked = F.transform(tops, lambda s: F.concat(_cut(pieces, s["past"], s["start"] - s["past"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    end = F.element_at(tops, -1)["end"]
    whole = F.concat(F.array_join(masked, ""), _cut(pieces, end, F.length(text) - end))
    return found.select("doc_id", *keep, F.when(F.size("spans") > 0, whole).otherwise(text).alias("text"), F.size("spans").alias("n_spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text, out of find_spans()."""
    spans = F.col("spans")

    def line(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(name: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id",
        *(count(k.name) for k in KINDS[:BASE]),
        F.sha2(line(F.filter(spans, lambda s: s["rank"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        line(spans).alias("spans"),
    )
