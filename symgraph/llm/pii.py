"""Personal data, by SQL functions only: candidate spans judged by gradient-boosted trees.

Base kinds (leftmost, non-overlapping per kind; failing matches are dropped without a retry): email, ip
(parts up to 255), card (14 to 19 digits passing the Luhn test), phone (international, 10 to 15 digits).

The method adds spans of four more kinds.  High-recall generators propose spans, which may overlap: digit
groups (as ``local_phone`` and as ``ssn``), letter-and-digit groups (``iban``), and addresses written out
(``masked_email``).  Each candidate gets format features (digits, groups, separators, check sums) and context
features (cue words before it, characters around it).  Boosted regression trees, written as CASE expressions,
add up to a log-odds; a threshold per kind, set on further generated examples so that PRECISION of what passes
is right, selects the spans.  A selected span that overlaps a base span is left to it, and one that lies
inside a longer selected span to that.

The trees are trained here: examples are generated from rules with a fixed seed, their features are computed
by the very expressions used on documents, and MAX_EXAMPLES rows of numbers come to the driver.  No corpus row
takes part, so the trees are the same everywhere.

Positions are code points, end exclusive.  A text is cut at its matches (marked by control characters that
are first replaced in the text if it has them), and the pieces' lengths give the positions.  There is no
Python, no join and no shuffle on the way: one row in, one row out; repeated rows are treated alike.  Null and
empty texts have no spans.
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("local_phone", "ssn", "iban", "masked_email")
PRECISION = 0.98
ROUNDS, DEPTH, RATE = 24, 3, 0.3
MAX_EXAMPLES = 6000
_OPEN, _SHUT, _OTHER = "\x01", "\x02", "\x03"

#: Only the first character of a run may begin a local part, or the place where the last match ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = r"(?<![A-Za-z0-9+])\(?[0-9]{2,5}\)?(?:[\x20./-]?[0-9]{2,5}){1,4}(?![A-Za-z0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_MASKED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}])\x20?[A-Za-z0-9-]{2,24}){1,4}"

SPAN = "array<struct<s:int,k:int,e:int,m:string,before:string,after:string>>"
SHORT = "array<struct<s:int,k:int,e:int>>"
#: Elements that a fold over an array takes at once.
_RUN = 64


def running(values: str, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """Fold of each element of an array column (of longs) with all before it; op is associative.

    A fold's state is copied at each step, so one that gathers an array takes time beyond linear.  Here runs of _RUN
    elements are folded to numbers, these to each run's start, and the runs' elements from there: states hold _RUN
    numbers, or one a run.  Lambdas refer to a column only, never to an expression, which they would compute anew for
    each element.
    """
    v, start = F.col(values), F.lit(zero).cast("long")
    run = lambda k: F.slice(v, k * _RUN + 1, F.lit(_RUN))
    grow = lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x)))
    count = F.ceil(F.size(v) / _RUN).cast("int")
    totals = F.transform(F.slice(F.sequence(F.lit(0), count), F.lit(1), count), lambda k: F.aggregate(run(k), start, op))
    starts = F.aggregate(totals, F.array(start), grow)
    return F.flatten(F.transform(starts, lambda s, k: F.aggregate(run(k), F.array(s), grow, lambda a: F.slice(a, F.lit(2), F.size(a)))))


_add = lambda a, b: a + b
_most = lambda a, b: F.greatest(a, b)
_least = lambda a, b: F.least(a, b)


def with_spans(df: DataFrame, text: str, made: dict[str, tuple[str, int, Column]]) -> DataFrame:
    """df with an array column of matches for each (pattern, kind, gate): start, kind, end, match, 40 characters before,
    4 after; none where the gate is closed.  What a later step reads more than once is a column, computed once a row.

    The text is cut before each match; a piece holds a match, a mark, and what follows it.
    """
    t, keep = F.col(text), df.columns
    piece, size, upto = ({n: f"_{x}{n}" for n in made} for x in ("piece", "size", "upto"))
    cut = lambda pattern, gate: F.when(gate, F.split(F.regexp_replace(t, pattern, f"{_OPEN}$0{_SHUT}"), _OPEN, -1)).otherwise(F.array().cast("array<string>"))
    df = df.select(*keep, *[cut(p, gate).alias(piece[n]) for n, (p, _, gate) in made.items()])
    df = df.select("*", *[F.transform(piece[n], lambda x: F.char_length(x).cast("long") - 1).alias(size[n]) for n in made])
    df = df.select("*", *[running(size[n], _add, 0).alias(upto[n]) for n in made])

    def spans(name: str, kind: int) -> Column:
        p, here = F.col(piece[name]), F.col(upto[name])
        pairs = F.zip_with(F.slice(p, F.lit(2), F.size(p)), F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, before: F.struct(x.alias("x"), before.alias("before")))

        def one(y: Column, sum_: Column) -> Column:
            match = F.substring_index(y["x"], _SHUT, 1)
            start = (sum_ + 1).cast("int")
            return F.struct(
                start.alias("s"), F.lit(kind).alias("k"), (start + F.char_length(match)).alias("e"), match.alias("m"),
                F.right(F.substring_index(y["before"], _SHUT, -1), F.lit(40)).alias("before"), F.substring(F.substring_index(y["x"], _SHUT, -1), 1, 4).alias("after"),
            )

        return F.zip_with(pairs, F.slice(here, F.lit(1), F.greatest(F.size(here) - 1, F.lit(0))), one)

    return df.select(*keep, *[spans(n, kind).alias(n) for n, (_, kind, _) in made.items()])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    """What a base match must pass."""
    n = F.length(_digits(x["m"]))
    if kind == "ip":
        return x["m"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(x["m"]))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_kinds(text: Column) -> dict[str, tuple[str, int, Column]]:
    """(pattern, kind, gate) of the base kinds."""
    digit = text.rlike("[0-9]")
    made = [(_EMAIL, text.contains("@")), (_IP, text.rlike(r"[0-9]\.[0-9]")), (_CARD, digit), (_PHONE, text.contains("+"))]
    return {f"_{kind}": (p, i, gate) for i, (kind, (p, gate)) in enumerate(zip(BASE, made))}


def generators(text: Column) -> dict[str, tuple[str, int, Column]]:
    """What proposes candidates: digit groups, letter-and-digit groups, addresses written out."""
    return {
        "_digits": (_DIGITS, 4, text.rlike("[0-9]")),
        "_iban": (_IBAN, 6, text.rlike("[A-Z]{2}[0-9]{2}")),
        "_masked": (_MASKED, 7, text.rlike(r"[\[({]\x20?(?:at|AT|@)")),
    }


def candidates() -> Column:
    """All proposals; digit groups are proposed under two kinds."""
    return F.concat("_digits", F.transform("_digits", lambda x: x.withField("k", F.lit(5))), F.col("_iban"), F.col("_masked"))


#: Cue words, by what they speak for.
_CUES = {
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|dial|whatsapp|telefon|téléphone|teléfono|handy)\b[^A-Za-z]{0,12}\w{0,8}[^A-Za-z]{0,3}$",
    "ssn": r"(?i)\b(?:ssn|social security|tax id|insurance number|sozialversicherung)\b",
    "bank": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "mail": r"(?i)\b(?:mail|e-mail|email|contact|write|reach)\b",
    "other": r"(?i)\b(?:order|version|isbn|issn|invoice|page|pages|serial|part|total|price|date|ref|id|no|figure|table|score|ratio|lat|lon|build)\b",
}


def features(x: Column) -> list[Column]:
    """Numbers that describe a candidate."""
    m, n = x["m"], F.length(_digits(x["m"]))
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    shape = F.regexp_replace(F.regexp_replace(m, "[0-9]", "9"), "[\\x20.()/]", "-")
    return [
        x["k"].cast("double"),
        n.cast("double"),
        F.char_length(m).cast("double"),
        (F.char_length(m) - F.length(F.regexp_replace(m, r"[\x20./()-]", ""))).cast("double"),
        flag(shape.rlike("^-?999-{1,2}999-9999$")),
        flag(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~m.rlike(r"^(?:000|666|9)|^...-00|-0000$")),
        flag(m.rlike(r"^(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]$|^[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}$")),
        flag(m.rlike(r"\.")),
        *[flag(x["before"].rlike(p)) for p in _CUES.values()],
        flag(x["before"].rlike(r"[#$€£=v]\x20?$")),
        flag(x["after"].rlike(r"^\x20?(?:%|€|\$|kg|km|cm|mm|MB|GB)")),
        flag(m.rlike(r"[A-Z]")),
    ]


def _example(rng: random.Random) -> tuple[str, int]:
    """A text with one item, and whether the item is personal data."""
    parts = ["ba", "ter", "on", "li", "sen", "que", "ment", "ar", "ei", "sch", "da", "re", "th", "ing", "o", "é"]
    words = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    d = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    good, cue = 1, ""
    kind = rng.randrange(16)
    if kind < 3:
        cue = rng.choice(["phone", "Tel:", "call me at", "mobile", "fax", "Telefon", "cell"])
        item = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(3)}/{d(3)}{d(4)}", f"0{d(2)} {d(4)} {d(4)}"])
    elif kind < 5:
        cue = rng.choice(["SSN", "social security", "ssn:", "tax id"])
        item = f"{rng.randrange(100, 665)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
    elif kind < 7:
        cue = rng.choice(["IBAN", "account", "Konto", "", "bank"])
        item = rng.choice([f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"FR{d(20)}", f"GB{d(2)}ABCD{d(14)}", f"ES{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)}"])
    elif kind < 8:
        cue = rng.choice(["mail", "contact", "", "reach"])
        name = rng.choice(parts) + rng.choice(parts)
        item = rng.choice([f"{name} [at] {words(1)} [dot] com", f"{name}(at){words(1)}.org", f"{name} (at) {words(1)} (dot) net"]).replace("é", "e")
    else:
        good = 0
        cue = rng.choice(["order", "version", "ISBN", "page", "date", "total", "ref", "", "", "", "", "lot"])
        item = rng.choice([d(16), d(rng.randrange(4, 20)), f"{d(4)}-{d(2)}-{d(2)}", f"19{d(2)}-0{rng.randrange(1, 9)}-1{d(1)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(3)} {d(3)}", f"{d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(2)}.{d(3)}.{d(3)}", f"AB{d(2)}CDEF{d(4)}", f"{d(3)}.{d(2)}.{d(2)}.{d(3)}"])
        if cue == "" and rng.random() < 0.2:
            item = rng.choice([f"{words(1)} [at] {words(1)}", f"f(at)x.{d(3)}"])
    return f"{words(rng.randrange(2, 9))} {cue} {item}{rng.choice([' ', '. ', ', '])}{words(rng.randrange(2, 9))}".replace("  ", " "), good


def _described(spark: SparkSession, seed: int, n: int) -> list[tuple[list[float], int]]:
    """(features, label) of the candidates in n generated texts, by the SQL expressions."""
    rng = random.Random(seed)
    rows = ",".join("('{}',{})".format(t.replace("\\", "\\\\").replace("'", "\\'"), y) for t, y in (_example(rng) for _ in range(n)))
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(text, y)")
    df = with_spans(df, "text", generators(F.col("text"))).select("y", F.explode(candidates()).alias("x"))
    kept = df.select("y", F.array(*features(F.col("x"))).alias("f")).orderBy("y", "f").limit(MAX_EXAMPLES)
    return [(list(r[1]), r[0] if _fits(r[1]) else 0) for r in kept.collect()]


def _fits(f) -> bool:
    """Digit groups are proposed twice; an example speaks for the kind that has its shape only."""
    return not (f[0] == 5 and f[5] == 0) and not (f[0] == 4 and f[5] == 1)


def _tree(rows: list[tuple[list[float], float, float]], depth: int):
    """A regression tree on (features, gradient, curvature): (feature, cut, below, above) or a leaf's value."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth and len(rows) > 10:
        for f in range(len(rows[0][0])):
            groups: dict[float, list[float]] = {}
            for r in rows:
                x = groups.setdefault(r[0][f], [0.0, 0.0])
                x[0] += r[1]
                x[1] += r[2]
            values, gl, hl = sorted(groups), 0.0, 0.0
            for a, b in zip(values, values[1:]):
                gl, hl = gl + groups[a][0], hl + groups[a][1]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, (a + b) / 2)
    if best is None:
        return round(RATE * g / (h + 1), 6)
    _, f, cut = best
    return f, cut, _tree([r for r in rows if r[0][f] <= cut], depth - 1), _tree([r for r in rows if r[0][f] > cut], depth - 1)


def _value(tree, f: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
    return tree


@functools.cache
def model(spark: SparkSession) -> tuple[tuple, dict[int, float]]:
    """(trees, threshold of the log-odds by kind)."""
    rows = _described(spark, 3, 1600)
    odds, trees = [0.0] * len(rows), []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in odds]
        tree = _tree([(f, y - q, q * (1 - q)) for (f, y), q in zip(rows, p)], DEPTH)
        trees.append(tree)
        odds = [s + _value(tree, f) for s, (f, _) in zip(odds, rows)]
    thresholds = {}
    fresh = [(f[0], sum(_value(t, f) for t in trees), y) for f, y in _described(spark, 4, 800)]
    for kind in range(4, 8):
        right = total = 0
        cut = math.inf
        mine = sorted((-s, y) for k, s, y in fresh if k == kind)
        for i, (s, y) in enumerate(mine):
            right, total = right + y, total + 1
            last = i + 1 == len(mine) or mine[i + 1][0] != s
            if last and right >= PRECISION * total:
                cut = -s
        thresholds[kind] = max(cut, 0.0)
    return tuple(trees), thresholds


def _case(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(f[tree[0]] <= tree[1], _case(tree[2], f)).otherwise(_case(tree[3], f))


def _short(x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))


def accepted(cands: Column, trees: tuple, thresholds: dict[int, float]) -> Column:
    """The candidates whose log-odds reach their kind's threshold, without their strings."""
    scored = F.transform(cands, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.array(*features(x)).alias("f")))
    odds = lambda y: functools.reduce(lambda a, b: a + b, [_case(t, y["f"]) for t in trees])
    cut = lambda k: functools.reduce(lambda c, i: c.when(k == i, F.lit(thresholds[i])), list(thresholds)[1:], F.when(k == 4, F.lit(thresholds[4])))
    return F.transform(F.filter(scored, lambda y: odds(y) >= cut(y["k"])), _short)


def apart(df: DataFrame, good: str, base: str, out: str) -> DataFrame:
    """df with the spans of one column that overlap none of another's: both in one order, with the furthest end of the
    base spans that begin before each, and the start of the next one."""
    mark = lambda t: lambda x: F.struct(x["s"].alias("s"), F.lit(t).alias("t"), x["e"].alias("e"), x["k"].alias("k"))
    keep, far = df.columns, F.lit(2**31).cast("long")
    none = F.array().cast("array<struct<s:int,t:int,e:int,k:int>>")
    both = F.when(F.size(good) > 0, F.sort_array(F.concat(F.transform(base, mark(0)), F.transform(good, mark(1))))).otherwise(none)
    df = df.select("*", both.alias("_both"))
    end = F.transform("_both", lambda x: F.when(x["t"] == 0, x["e"].cast("long")).otherwise(F.lit(0).cast("long")))
    start = F.transform(F.reverse("_both"), lambda x: F.when(x["t"] == 0, x["s"].cast("long")).otherwise(far))
    df = df.select("*", end.alias("_end"), start.alias("_start"))
    reach, after = running("_end", _most, 0), F.reverse(running("_start", _least, 2**31))
    seen = F.zip_with(F.zip_with("_both", reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), after, lambda y, n: F.struct(y["x"].alias("x"), y["r"].alias("r"), n.alias("n")))
    free = F.filter(seen, lambda y: (y["x"]["t"] == 1) & (y["r"] <= y["x"]["s"]) & (y["n"] >= y["x"]["e"]))
    return df.select(*keep, F.transform(free, lambda y: _short(y["x"])).alias(out))


def outermost(df: DataFrame, spans: str, out: str) -> DataFrame:
    """df with those spans of a column that lie in no longer one of it.

    In the order of start and, from the longest, of end, a longer span around another one comes before it; it has a
    larger end, or the same with a smaller start.
    """
    keep, size = df.columns, 1 << 32
    order = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["k"].alias("k"))))
    df = df.select("*", order.alias("_order"))
    df = df.select("*", F.transform("_order", lambda x: -x["n"].cast("long") * size - x["s"]).alias("_rank"))
    seen = F.zip_with("_order", F.zip_with("_rank", running("_rank", _most, 0), lambda r, top: top > r), lambda x, inside: F.struct(x.alias("x"), inside.alias("inside")))
    found = F.transform(F.filter(seen, lambda y: ~y["inside"]), lambda y: F.struct(y["x"]["s"].alias("s"), y["x"]["k"].alias("k"), (-y["x"]["n"]).alias("e")))
    return df.select(*keep, found.alias(out))


def _joined(spans: Column, names: tuple) -> Column:
    kind = F.array(*[F.lit(k) for k in names])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts per base kind, base digest, all spans."""
    trees, thresholds = model(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    clean = F.when(text.contains(_OPEN) | text.contains(_SHUT), F.translate(text, _OPEN + _SHUT, _OTHER * 2)).otherwise(text)
    names, t = [f"n_{k}" for k in BASE], F.col("_t")
    df = with_spans(docs.select(F.col(id_col).alias("_id"), clean.alias("_t")), "_t", base_kinds(t) | generators(t))
    df = df.select("_id", *[F.filter(f"_{k}", functools.partial(_valid, k)).alias(f"_{k}") for k in BASE], candidates().alias("_cands"))
    base = F.sort_array(F.concat(*[F.transform(f"_{k}", _short) for k in BASE]))
    good = F.when(F.size("_cands") > 0, accepted(F.col("_cands"), trees, thresholds)).otherwise(F.array().cast(SHORT))
    df = df.select("_id", *[F.size(f"_{k}").cast("long").alias(n) for k, n in zip(BASE, names)], base.alias("_base"), good.alias("_good"))
    df = outermost(apart(df, "_good", "_base", "_apart"), "_apart", "_more")
    return df.select(
        F.col("_id").alias(id_col),
        *names,
        F.sha2(_joined(F.col("_base"), BASE).cast("binary"), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("_base", "_more")), BASE + MORE).alias("spans"),
        F.size("_more").cast("long").alias("n_more"),
    )
