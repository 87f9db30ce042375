"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Generators with high recall propose spans, which may overlap: the base patterns, and for each kind
looser ones (card groups inside longer digit runs, numbers without the international sign, spelled
out mail addresses). Every looser candidate is described by its format and context; boosted trees,
unrolled to CASE expressions, score it, and a calibrated threshold selects. Valid base matches
always stay; of the rest the best by kind and start that overlap nothing chosen before stay too.

It is a narrow map: all candidates of a document live in an array on its row, so there is no
shuffle, no group and nothing on the driver but the trees.

The patterns are written so that Java's matcher neither recurses nor backs off over long runs
(possessive repeats, starts only where a run starts), which keeps very long texts linear.

Edge cases: null and empty texts have no spans; repeated rows each get a row; an empty table gives
no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii_trees import FEATURES, KINDS, fitted

P = "__p1_"
_LOCAL = "[A-Za-z0-9._%+-]"
#: Base patterns by kind. They match what the documented plain patterns match, at the same places.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns by kind.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{2,63}+){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?\.\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}|[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:00|\+)[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{3,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: What must be in a text for a loose pattern to be tried; each is a plain scan.
HINT = {"email": r"(?:\(at\)|\[at\]|@)", "ip": r"[0-9]\x20?\.\x20?[0-9]", "card": r"[0-9]{4}", "phone": r"[0-9]{3,4}\)?[\x20.-][0-9]{3}"}
#: Telling words before a span, by kind.
CUES = {"email": "mail|contact|write", "ip": "ip|host|server|address|login", "card": "card|visa|credit|payment|cc", "phone": "tel|phone|call|fax|mobile"}
CONTEXT = 24
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _spans(text: Column, pattern: str) -> Column:
    """Array of struct(start, s): leftmost non-overlapping matches. Each match of the joined pattern
    takes the text from the end of the one before, so running lengths give the places."""
    joined = rf"(?s)\G(.*?)({pattern})"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(joined), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(joined), F.lit(2)).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,s:string>>").alias("out"))
    return F.aggregate(
        pairs,
        zero,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["s"])).cast("long").alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).cast("long").alias("start"), x["s"].alias("s")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The checksum of at most 20 digits."""
    d = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        c = F.substring(d, i + 1, 1).cast("int")
        total = total + (F.when(c > 4, 2 * c - 9).otherwise(2 * c) if i % 2 == 0 else c)
    return total % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    d = _digits(s)
    return F.length(d).between(13, 19) & _luhn(d) if kind == "card" else F.length(d).between(9, 15)


def _shape(kind: str, s: Column) -> Column:
    """The groups have the sizes in which the kind is written."""
    return {
        "email": s.rlike(r"[A-Za-z]{2,10}$") & s.rlike(r"\(at\)|\[at\]|^[^\x20]+@[^\x20]+$"),
        "ip": F.regexp_replace(s, " ", "").rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": s.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:\x20[0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$"),
        "phone": s.rlike(r"^(?:(?:00|\+)[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"),
    }[kind]


def _features(kind: str, text: Column, x: Column) -> dict[str, Column]:
    s, start = x["s"], x["start"].cast("int")
    before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    # what touches the span is looked up in it and one code point on either side
    after = F.substring(text, start + F.length(s) + 1, F.lit(1))
    digits = _digits(s)
    num = lambda b: b.cast("int")
    return {
        "kind": F.lit(KINDS.index(kind)),
        "digits": F.length(digits),
        "seps": F.length(F.regexp_replace(s, r"[^\x20.()-]", "")),
        "luhn": num(_luhn(digits)) if kind == "card" else F.lit(0),
        "led": num(s.rlike(r"^(?:\+|00|\()")),
        "cue": num(F.lower(before).rlike(rf"(?:{CUES[kind]})[^\n]{{0,12}}$")),
        "glued": num(before.rlike(r"[\p{L}\p{N}@/_]$") | after.rlike(r"^[\p{L}\p{N}@/_]")),
        "parts_ok": num(_shape(kind, s)),
    }


def _tree(node, x: Column) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    f, cut, left, right = node
    return F.when(x[FEATURES[f]] < F.lit(cut), _tree(left, x)).otherwise(_tree(right, x))


def _chosen(x: Column) -> Column:
    trees, threshold = fitted()
    total = F.lit(0.0)
    for t in trees:
        total = total + _tree(t, x)
    return total >= F.lit(threshold)


def _for(kind: str, f):
    return lambda x: f(kind, x)


def _end(x: Column) -> Column:
    return x["start"] + F.length(x["s"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with two columns more: {P}base and {P}more, arrays of struct(kind, start, end): valid
    base matches, and the spans that the trees add to them, by kind and start."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:long,s:string>>")
    quick = {"email": F.contains(t, F.lit("@")), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.contains(t, F.lit("+"))}
    found = docs.withColumns({f"{P}{k}": F.when(quick[k], _spans(t, BASE[k])).otherwise(none) for k in KINDS})
    found = found.withColumns({f"{P}{k}": F.filter(F.col(f"{P}{k}"), _for(k, lambda k, x: _valid(k, x["s"]))) for k in KINDS})
    found = found.withColumns({f"{P}{k}_raw": F.when(t.rlike(HINT[k]), _spans(t, LOOSE[k])).otherwise(none) for k in KINDS})
    wide = lambda k, x: F.struct(F.lit(KINDS.index(k)).alias("kind"), x["start"].alias("start"), _end(x).alias("end"))
    base = F.concat(*[F.transform(F.col(f"{P}{k}"), _for(k, wide)) for k in KINDS])
    found = found.withColumn(P + "base", base)
    clear = lambda x: ~F.exists(F.col(P + "base"), lambda b: (x["start"] < b["end"]) & (_end(x) > b["start"]))
    described = lambda k, x: F.struct(x["start"].alias("start"), _end(x).alias("end"), *[v.alias(n) for n, v in _features(k, t, x).items()])
    found = found.withColumn(P + "cands", F.concat(*[F.transform(F.filter(F.col(f"{P}{k}_raw"), clear), _for(k, described)) for k in KINDS]))
    picked = F.transform(F.filter(F.col(P + "cands"), _chosen), lambda x: F.struct(x["kind"], x["start"], x["end"]))
    kept = "array<struct<kind:int,start:long,end:long>>"
    more = F.aggregate(picked, F.array().cast(kept), lambda acc, x: F.when(F.exists(acc, lambda b: (x["start"] < b["end"]) & (x["end"] > b["start"])), acc).otherwise(F.concat(acc, F.array(x))))
    return found.withColumn(P + "more", F.when(F.size(picked) > 0, more).otherwise(F.array().cast(kept))).select(*docs.columns, P + "base", P + "more")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base matches by kind, the digest of the base spans, and all spans, by document."""
    base = F.col(P + "base")
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scan(docs.select(key, text), text).select(
        key,
        *map(count, KINDS),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.sort_array(F.concat(base, F.col(P + "more")))).alias("spans"),
        F.size(F.col(P + "more")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in text replaced by its kind in brackets, such as [EMAIL]. Of spans that
    overlap, the union is replaced, under the kind of the first. Null texts stay null."""
    t, names = F.col(text), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.array_sort(F.concat(F.col(P + "base"), F.col(P + "more")), lambda a, b: (F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["kind"] - b["kind"])))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.substring(t, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    done = F.aggregate(
        spans,
        zero,
        lambda acc, x: F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], piece(acc["at"], x["start"]), F.element_at(names, x["kind"] + 1))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    clean = F.when(F.size(F.col(P + "base")) + F.size(F.col(P + "more")) > 0, done).otherwise(t)
    return scan(docs, text).withColumn(text, clean).select(*docs.columns)
