"""Personal data by candidate gradient boosting, in DataFrame expressions only.

1. Strict patterns with their checks (lengths, octets, Luhn) give the base spans.
2. Looser generators propose overlapping spans: mail addresses also where the @ is spelled out or the host has no
   dot, dotted quads of any numbers, colon groups, unbroken digit runs, grouped numbers, account numbers.
3. A candidate is verified if its own check holds: a base span of its kind lies on it, or the syntax of an IPv6
   address or the check digits of an account number are right. Verified ones are the positive labels; the
   others carry no label, as a mistyped or disguised number fails its check and is personal all the same.
4. Every candidate becomes a vector of yes/no features of its format and its context. The part that the check
   decides by (the @, the octets' range, the plus, the check digits) is no feature, so the trees can't copy
   the checks: they learn what verified candidates look like and where they stand. Spark counts how often each vector
   occurs, verified or not, by fold, over all texts; the table has at most 2 ** ``N_FEATURES`` vectors, however large
   the corpus is. On it the driver grows Newton-boosted trees of depth two.
5. Thresholds are calibrated on out-of-fold scores: isotonic regression gives the share of verified candidates at
   each score, and that share divided by its mean over the verified ones (how often a true one passes the check)
   is the probability that a candidate is true, as Elkan and Noto estimate it from positive and unlabelled data,
   both less what passes by chance.
   A generator's threshold is the least score where it reaches ``PROBABILITY``. Trees and thresholds become one
   expression, which selects candidates in place. Selected spans that overlap no base span are added.

Positions come from the pieces between matches, so they count code points. No text is shuffled. Places, overlaps and
redactions are worked out with running sums and maxima, so the work grows with a text and its spans, not with
their product.

Defined cases: a null text is empty and has no spans; repeated rows get equal rows; a generator without verified
candidates adds nothing; an empty table gives no rows; extra columns are ignored. ``redact`` keeps null texts null,
rows without spans as they are, and all columns, whatever they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.arrays import before, let, scan
from talkmill.functions.text import blocks, cut

from .common import fold, whole_text

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind, pattern, what a text must hold for it to match. They match what the plain patterns of the contract match,
#: but never scan a run twice: a run is entered at its start only (or where the last match ended), and kept whole.
BASE = (
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[ -]?[0-9]){11,}+", r"[0-9](?:[ -]?[0-9]){11}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
)
_AT, _DOT = r" ?[\[({](?i:at)[\])}] ?", r" ?[\[({](?i:dot)[\])}] ?| (?i:dot) "
#: What proposes candidates: kind of the span it would add, pattern, what a text must hold, the base kinds
#: that verify it, the share of other candidates whose check holds by chance (one in ten for a check digit, in 97 for two).
GENERATORS = (
    ("mail", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?:(?:@|{_AT}){_HOST}++(?:(?:\.|{_DOT}){_HOST}++)*+| (?i:at) {_HOST}++(?:(?:\.|{_DOT}){_HOST}++)++)",
     r"@|[\[({](?i:at)[\])}]| (?i:at) [A-Za-z0-9-]+(?:\.[A-Za-z0-9]|[ \[({]+(?i:dot))", (0,), 0.0),
    ("host", r"(?<![0-9A-Za-z.])[0-9]++(?:(?:\.|\[\.\]|\(\.\))[0-9]++){3}(?![0-9A-Za-z]|\.[0-9])", r"[0-9][\])]?\.|[\[(]\.[\])][0-9]", (1,), 0.0),
    ("net", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f:]*:[0-9A-Fa-f]", (), 0.0),
    ("digits", r"(?<![0-9])[0-9]{7,19}+(?![0-9])", r"[0-9]{7}", (2, 3), 0.1),
    ("number", r"(?<![0-9A-Za-z])(?:[0-9]{1,3}[ ./-])?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}[0-9]{2,6}){1,5}+(?![0-9A-Za-z])", r"[0-9]\)?[ ./-]{1,2}[0-9]", (2, 3), 0.1),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", (), 1 / 97),
)
_NAMES = [g for g, *_ in GENERATORS]
CUES = r"(?i)(?:call|tel|phone|mobil|fax|mail|contact|card|visa|iban|account|konto|ssn|host|server|ip|addr)"
#: What a number that is no personal one is led in by.
OTHER = r"(?i)(?:order|invoice|sku|isbn|ref|item|version|ver|build|page|token|key|hash|id|nr|no)[\s:.#=\"']*$"
#: Characters of context before a candidate.
CONTEXT = 24
TREES, RATE, SMOOTH, FOLDS = 30, 0.3, 1.0, 5
PROBABILITY = 0.5
SPAN = "array<struct<start: bigint, end: bigint, kind: int, match: string>>"
FOUND = "array<struct<start: bigint, end: bigint, kind: int, match: string, before: string, after: string>>"
KINDS = [k for k, *_ in BASE] + _NAMES
_FAR = 2**62


def spans(text: Column, pattern: str, needs: str, kind: int, context: bool = False) -> Column:
    """All leftmost non-overlapping matches as structs with their places in code points; with context, what stands
    beside them (as far as to the match before)."""
    told = text.contains(needs) if needs == "@" else text.rlike(needs)

    def one(pieces: Column, starts: Column, m: Column, i: Column) -> Column:
        piece = F.get(pieces, i)
        start = F.get(starts, i) + F.length(piece)
        out = [start.alias("start"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("match")]
        if context:
            out += [F.right(piece, F.lit(CONTEXT)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("after")]
        return F.struct(*out)

    def placed(pieces: Column, matches: Column) -> Column:
        sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
        return let(before(sizes), lambda starts: F.transform(matches, lambda m, i: one(pieces, starts, m, i)))

    split = F.split(text, pattern, -1)
    every = let(split, lambda ps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda ms: placed(ps, ms)))
    return F.when(told, every).otherwise(F.array().cast(FOUND if context else SPAN))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def mod97(account: Column) -> Column:
    """Whether an account number's check digits are right (ISO 7064, letters as 10 to 35)."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4))), ""), lambda ch: ch != "")
    add = lambda t, ch: F.when(ch <= "9", t * 10 + F.ascii(ch) - 48).otherwise(t * 100 + F.ascii(ch) - 55) % 97
    return F.aggregate(turned, F.lit(0), add) == 1


def is_ipv6(match: Column) -> Column:
    return match.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | (match.rlike("^[^:]+(?::[^:]+)*::[^:]+(?::[^:]+)*$") & (F.size(F.split(match, "::?")) <= 7))


def _valid(s: Column) -> Column:
    m = s["match"]
    octets = m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    n = F.length(digits(m))
    return (
        F.when(s["kind"] == 0, F.lit(True))
        .when(s["kind"] == 1, octets)
        .when(s["kind"] == 2, (n <= 19) & luhn(digits(m)))
        .otherwise((n >= 9) & (n <= 15))
    )


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind as listed."""
    found = F.concat(*(spans(text, p, needs, k) for k, (_, p, needs) in enumerate(BASE)))
    return F.array_sort(F.filter(found, _valid))


def candidate_spans(text: Column) -> Column:
    """What the generators propose, by place, the number of the generator as its kind."""
    return F.array_sort(F.concat(*(spans(text, p, needs, k, context=True) for k, (_, p, needs, *_) in enumerate(GENERATORS))))


def features(s: Column) -> list[Column]:
    """Yes/no features of a candidate's format and of what stands around it; none of what its check decides by."""
    m, kind = s["match"], s["kind"]
    n = F.length(digits(m))
    number, mail = kind == _NAMES.index("number"), kind == _NAMES.index("mail")  # brackets and blanks of mails disguise the @
    return [
        *(kind == k for k in range(len(GENERATORS) - 1)),
        n >= 9, n >= 12, n >= 14, n >= 16,
        number & m.rlike(r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"),
        number & m.rlike("[0-9]{3}[ .-][0-9]{4}$"), number & m.contains("("), number & m.rlike(r"[0-9]\.[0-9]"),
        number & m.rlike("(?:19|20)[0-9]{2}[-./](?:0[0-9]|1[0-2])"),
        mail & m.rlike("[A-Za-z]{2,6}$"), mail & m.rlike(rf"^[A-Za-z%+-]*[._0-9]{_LOCAL}*"), mail & m.rlike(" (?i:at) "),
        s["before"].rlike("[0-9A-Za-z_./=#%$€-]$") | s["after"].rlike("[0-9A-Za-z_%$€]"),
        s["before"].rlike(CUES), s["before"].rlike(OTHER),
    ]


N_FEATURES = 20


def ordered(found: Column, base: Column) -> Column:
    """Base spans and candidates in one array by start, base spans first."""
    mark = lambda b: lambda s: F.struct(s["start"].alias("start"), F.lit(not b).alias("own"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(b).alias("base"))
    return F.array_sort(F.concat(F.transform(base, mark(True)), F.transform(found, mark(False))))


def touched(order: Column, kinds: tuple[int, ...]) -> Column:
    """array<boolean>: whether any base span of these kinds lies on each candidate of ``ordered``."""
    mine = lambda x: x["base"] & x["kind"].isin(*kinds)
    ends = F.transform(order, lambda x: F.when(mine(x), x["end"]).otherwise(F.lit(0).cast("bigint")))
    starts = F.transform(F.reverse(order), lambda x: F.when(mine(x), x["start"]).otherwise(F.lit(_FAR)))
    last = scan(ends, F.lit(0), lambda a, b: F.greatest(a, b), 0)
    after = F.reverse(scan(starts, F.lit(_FAR), lambda a, b: F.least(a, b), _FAR))
    sides = F.zip_with(last, after, lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    hit = F.zip_with(order, sides, lambda x, s: F.struct(x["base"].alias("base"), ((s["l"] > x["start"]) | (s["r"] < x["end"])).alias("hit")))
    return F.transform(F.filter(hit, lambda x: ~x["base"]), lambda x: x["hit"])


#: The base kinds that verify candidates, by group of generators.
_GROUPS = sorted({ks for *_, ks, _ in GENERATORS if ks})


def verified(s: Column, hits: list[Column]) -> Column:
    """Whether a candidate's own check holds; hits: whether base spans of each group lie on it."""
    out = F.when(s["kind"] == _NAMES.index("net"), is_ipv6(s["match"])).when(s["kind"] == _NAMES.index("account"), mod97(s["match"]))
    for ks, hit in zip(_GROUPS, hits):
        out = out.when(s["kind"].isin(*(g for g, (*_, own, _) in enumerate(GENERATORS) if own == ks)), hit)
    return out


def described(found: Column) -> Column:
    """The candidates with their features in an array: each tree looks them up, and none is worked out twice."""
    return F.transform(found, lambda s: F.struct(s.alias("s"), F.array(*features(s)).alias("f")))


def counts(docs: DataFrame) -> list[tuple[tuple[bool, ...], int, int, bool, int]]:
    """(features, generator, fold, verified, how often) over all candidates of all texts."""
    t = docs.select(whole_text().alias("text"), fold("doc_id", FOLDS).cast("int").alias("fold"))
    t = t.select("fold", base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("s")).filter(F.size("s") > 0)
    t = t.select("fold", "s", ordered(F.col("s"), F.col("base")).alias("order"))
    t = t.select("fold", "s", *(touched(F.col("order"), ks).alias(f"h{i}") for i, ks in enumerate(_GROUPS)))
    # whole arrays are zipped: one that a lambda captures would be worked out anew for each candidate
    rows = t.select("fold", F.explode(F.arrays_zip("s", *(f"h{i}" for i in range(len(_GROUPS))))).alias("x"))
    y = verified(F.col("x.s"), [F.col(f"x.h{i}") for i in range(len(_GROUPS))])
    rows = rows.select("fold", F.col("x.s.kind").alias("g"), F.array(*features(F.col("x.s"))).alias("f"), y.alias("y"))
    bits = F.aggregate("f", F.lit(0), lambda a, b: a * 2 + b.cast("int"))
    rows = rows.select(bits.alias("f"), "g", "fold", "y").groupBy("f", "g", "fold", "y").count().collect()
    unpack = lambda v: tuple(bool(v >> (N_FEATURES - 1 - i) & 1) for i in range(N_FEATURES))
    return sorted((unpack(r["f"]), r["g"], r["fold"], bool(r["y"]), r["count"]) for r in rows)


@dataclass
class Trees:
    """Boosted trees as (feature, (feature, no, yes), (feature, no, yes)), with a threshold for each generator."""

    prior: float
    trees: list[tuple]
    thresholds: list[float] = field(default_factory=list)

    def score(self, f: tuple[bool, ...]) -> float:
        total = self.prior
        for root, no, yes in self.trees:
            feature, low, high = yes if f[root] else no
            total += high if f[feature] else low
        return total

    def column(self, f: list[Column]) -> Column:
        leaf = lambda b: F.when(f[b[0]], F.lit(b[2])).otherwise(F.lit(b[1]))
        parts = [F.when(f[root], leaf(yes)).otherwise(leaf(no)) for root, no, yes in self.trees]
        return sum(parts, F.lit(self.prior))


def boost(table: list[tuple], trees: int = TREES) -> Trees:
    """Newton boosting of the log loss on counted feature vectors."""
    merged: dict = {}
    for f, _, _, y, n in table:
        pos, total = merged.get(f, (0, 0))
        merged[f] = (pos + n * y, total + n)
    rows = sorted(merged.items())
    pos, total = (np.array([c[k] for _, c in rows], dtype=float) for k in (0, 1))
    prior = math.log((pos.sum() + 0.5) / (total.sum() - pos.sum() + 0.5))
    out = Trees(prior, [])
    if not 0 < pos.sum() < total.sum():
        return out
    x = np.array([f for f, _ in rows], dtype=float)
    own = lambda g, h: g * g / (h + SMOOTH)
    logit = np.full(len(rows), prior)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-logit))
        g, h = total * q - pos, total * q * (1 - q)
        # sums over the rows with feature r (column 1) or without it (column 0), and within them over those with feature k
        sums = {}
        for v in (0, 1):
            side = x if v else 1 - x
            sums[v] = ((side * g[:, None]).sum(0), (side * h[:, None]).sum(0), x.T @ (side * g[:, None]), x.T @ (side * h[:, None]))
        gain = {}
        for v, (ga, ha, gk, hk) in sums.items():
            gain[v] = own(gk, hk) + own(ga - gk, ha - hk)  # features k by roots r
        best = gain[0].max(0) + gain[1].max(0)
        best[(x.min(0) == x.max(0))] = -np.inf
        if not np.isfinite(best.max()):
            break
        root = int(np.argmax(np.round(best, 9)))
        leaves = []
        for v in (0, 1):
            ga, ha, gk, hk = sums[v]
            k = int(np.argmax(np.round(gain[v][:, root], 9)))
            step = lambda a, b: float(RATE * np.clip(-a / (b + SMOOTH), -4, 4))
            leaves.append((k, step(ga[root] - gk[k, root], ha[root] - hk[k, root]), step(gk[k, root], hk[k, root])))
        out.trees.append((root, *leaves))
        picked = np.where(x[:, root] > 0, np.where(x[:, leaves[1][0]] > 0, leaves[1][2], leaves[1][1]), np.where(x[:, leaves[0][0]] > 0, leaves[0][2], leaves[0][1]))
        logit = logit + picked
    return out


def isotonic(points: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Points (score, verified, all) pooled until shares never fall as scores rise."""
    pools: list[list[float]] = []
    for score, pos, n in sorted(points):
        pools.append([score, pos, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, p, m = pools.pop()
            pools[-1][1] += p
            pools[-1][2] += m
    return [tuple(x) for x in pools]


def wilson(pos: int, n: int, z: float = 1.64) -> float:
    """The lower end of the interval that a share of pos in n stands for."""
    p = pos / n
    return (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def calibrated(points: list[tuple[float, int, int]], chance: float = 0.0) -> list[tuple[float, float]]:
    """(score, probability that a candidate from that score on is a true one).

    chance: the share of others whose check holds by chance. None are told without verified candidates, or where
    their share nowhere exceeds chance for certain, as the check then says nothing.
    """
    pools = isotonic(points)
    of = lambda score: max((x for x in pools if x[0] <= score), default=pools[0])
    found = sum(p for _, p, _ in points)
    if not found or wilson(*pools[-1][1:]) <= chance:
        return []
    share = lambda pool: pool[1] / pool[2]
    passing = sum(p * share(of(s)) for s, p, _ in points) / found  # how often a true one passes its check
    return [(x[0], min(1.0, max(0.0, (share(x) - chance) / (passing - chance)))) for x in pools] if passing > chance else []


def train(docs: DataFrame, probability: float = PROBABILITY) -> Trees:
    table = counts(docs)
    model = boost(table)
    points: dict[int, dict[float, list[int]]] = {}
    for k in range(FOLDS):
        part = boost([r for r in table if r[2] != k])
        for f, g, own, y, n in table:
            if own == k:
                pair = points.setdefault(g, {}).setdefault(round(part.score(f), 6), [0, 0])
                pair[0] += n * y
                pair[1] += n
    for g in range(len(GENERATORS)):
        told = calibrated([(s, p, n) for s, (p, n) in points.get(g, {}).items()], GENERATORS[g][4])
        model.thresholds.append(min((s for s, p in told if p >= probability), default=math.inf) - 1e-6)
    return model


def found(docs: DataFrame, model: Trees, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, the whole text, base spans, and the added ones (kinds go on after the base's)."""
    t = docs.select(*keep, whole_text(text).alias("_text"))
    t = t.select(*keep, "_text", base_spans(F.col("_text")).alias("_base"), candidate_spans(F.col("_text")).alias("s"))
    t = t.withColumn("h", touched(ordered(F.col("s"), F.col("_base")), tuple(range(len(BASE)))))

    def chosen(c: Column) -> Column:
        least = F.lit(math.inf)
        for g, own in enumerate(model.thresholds):
            least = F.when(c["s"]["kind"] == g, F.lit(own)).otherwise(least)
        return model.column([F.get(c["f"], F.lit(i)) for i in range(N_FEATURES)]) >= least

    free = F.transform(F.filter(F.arrays_zip("s", "h"), lambda x: ~x["h"]), lambda x: x["s"])
    more = F.transform(
        F.filter(described(free), chosen),
        lambda c: F.struct(c["s"]["start"].alias("start"), c["s"]["end"].alias("end"), (c["s"]["kind"] + len(BASE)).alias("kind"), c["s"]["match"].alias("match")),
    )
    return t.select(*keep, "_text", "_base", F.when(F.size("s") > 0, more).otherwise(F.array().cast(SPAN)).alias("_more"))


def _listed(xs: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    by_start = F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(by_start), one), ",")


def digest(docs: DataFrame) -> DataFrame:
    rows = found(docs, train(docs), ["doc_id"])
    number = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *(number(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)),
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.concat("_base", "_more")).alias("spans"),
    )


def _merged(xs: Column, reach: Column) -> Column:
    """array<struct<start, end, kind>> of the runs of overlapping spans xs (by start), each of its first one's kind.

    reach: the farthest end of the spans before each; a run reaches to what the next one's first span found so.
    """
    heads = F.filter(F.transform(reach, lambda r, i: F.when(F.get(xs, i)["start"] >= r, i)), lambda i: i.isNotNull())
    end = lambda hs, k: F.coalesce(F.get(reach, F.get(hs, k + 1)), F.array_max(F.transform(xs, lambda s: s["end"])))
    run = lambda hs: F.transform(hs, lambda i, k: F.struct(F.get(xs, i)["start"].alias("start"), end(hs, k).alias("end"), F.get(xs, i)["kind"].alias("kind")))
    return let(heads, run)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Columns stay as they are, but for the text of rows with spans and, where there is one, their ``n_chars``. Null
    and empty texts, texts without spans and repeated rows stay; an empty table gives no rows.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # under names of its own no column clashes with a helper's
    at = [n.lower() for n in names].index("text")
    own = docs.toDF(*plain)
    rows = found(own.withColumn("doc_id", F.col(plain[[n.lower() for n in names].index("doc_id")])), train(docs), plain, plain[at])
    kinds = F.array(*map(lambda k: F.lit(f"[{k.upper()}]"), KINDS))
    spans_ = F.transform(F.concat("_base", "_more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    def rewritten(runs: Column, bs: Column, n: Column) -> Column:
        gap = lambda i: F.coalesce(F.get(runs, i - 1)["end"], F.lit(0).cast("bigint"))
        parts = F.transform(runs, lambda s, i: F.concat(cut(bs, F.when(i > 0, gap(i)).otherwise(0), s["start"]), F.get(kinds, s["kind"])))
        return F.concat(F.array_join(parts, ""), cut(bs, F.element_at(runs, -1)["end"], n))

    some = F.size("_base") + F.size("_more") > 0
    rows = rows.withColumn("_some", some).withColumn("_spans", F.array_sort(spans_))
    rows = rows.withColumn("_reach", scan(F.transform("_spans", lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b), 0))
    merged = let(F.col("_spans"), lambda xs: let(F.col("_reach"), lambda r: _merged(xs, r)))
    rows = rows.withColumn("_runs", F.when(F.col("_some"), merged))
    new = let(F.col("_runs"), lambda rs: let(blocks(F.col("_text")), lambda bs: let(F.length("_text").cast("bigint"), lambda n: rewritten(rs, bs, n))))
    rows = rows.withColumn("_new", F.when(F.col("_some"), new))
    out = {at: F.coalesce("_new", F.col(plain[at]).cast("string"))}
    for i, n in enumerate(names):
        if n.lower() == "n_chars":
            out[i] = F.when(F.col("_some"), F.length("_new")).otherwise(F.col(plain[i])).cast(docs.schema[i].dataType)
    return rows.select(*(out.get(i, F.col(c)).alias(n) for i, (c, n) in enumerate(zip(plain, names))))
