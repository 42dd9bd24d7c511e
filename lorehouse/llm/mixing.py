"""Mixing sources to target weights with soft membership, in DataFrame functions alone.

1. ``described``: one scan of the whole texts gives each row its number of words and a few small numbers about its text:
   language, bins of length, word length and character shares, and ``MINS`` minimum hashes of its words. Everything
   after reads this table, never a text again.
2. ``memberships``: a naive Bayes classifier, fitted to the rows with a declared source, predicts a posterior over the
   domains from the text's numbers alone; the source is its label and no input. The weight of the text's evidence is the
   one of ``WEIGHTS`` with the best likelihood on a fold that the counts leave out: where text cannot tell the sources
   apart, the posterior is the prior. With ``doubt`` the declared source is evidence too, wrong with that probability.
3. ``fitted``: projected gradient least squares for nonnegative rates r. With S_d the expected words of domain d under
   the rates, T_d its target and M_d its mass, it minimises the sum of (S_d - T_d)^2 / M_d plus ``hold`` times the sum of
   words * (r - 1)^2, so rates stay near 1 where the posterior says nothing. A step moves every rate by a weighted sum of
   its posterior, so a rate is max(0, 1 - p . m) for one vector m: a step is one pass of sums, as many numbers to the
   driver as there are domains.
4. A row is taken ``floor(rate + u)`` times, u a fixed number in [0, 1) from its id and text.

Default targets are proportional to mass ** ``temper``; the default total is the corpus's own words, so a small domain is
repeated and cannot shrink the others. ``repeat``, which is off by default, bounds a target to so many times its domain's
words; what a domain at that bound cannot take goes to the others by their weights. Every row tells of its domain the words
wanted (``domain_target``) and the words that the rates give it in expectation (``domain_expected``): where the text does
not tell domains apart, no rate can move one without the others, and the two differ.
Sources beyond the ``MAX_DOMAINS - 1`` with the most words are one domain, ``OTHERS``. ``kept_words`` reports each domain.

Defined results: null and empty texts have no words, so their rate never matters to the totals and follows their
posterior. Without any declared source there is one domain, ``""``. Repeated rows get the same rate and copies. Other
columns pass through; columns named like the results (``RESULTS``) are replaced by them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import inf, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, held, words_of

RESULTS = ("n_words", "domain", "rate", "copies", "domain_target", "domain_expected")
#: Minimum hashes of a text, and how many values each number about a text has.
MINS, VALUES = 3, 128
#: At most so many domains: their totals and the classifier's counts, and nothing else, come to the driver.
MAX_DOMAINS = 256
#: Weights of the text's evidence to choose from, and the part of the labelled rows that chooses.
WEIGHTS, FOLDS = (0.0, 0.05, 0.1, 0.25, 0.5, 1.0), 5
#: The domain of all rarer sources.
OTHERS = "(other sources)"
_SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)


def _literal(value: object, kind: str) -> Column:
    """A literal of many numbers or names, folded by the optimiser to one."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _add(a: Column, b: Column) -> Column:
    return a + b


@dataclass(frozen=True)
class Described:
    table: DataFrame  # the columns kept, then the four below
    n: str
    x: str
    u: str
    source: str


def described(docs: DataFrame, keep: Sequence[str], id_col: str, text_col: str, source_col: str, lang_col: str) -> Described:
    names = {k: free_name(docs, f"__{k}") for k in ("text", "words", "hashes", "n", "x", "u", "source")}
    c = {k: F.col(f"`{v}`") for k, v in names.items()}
    u = F.shiftrightunsigned(F.xxhash64(docs[id_col].cast("string"), docs[text_col].cast("string")), 11) / F.lit(float(1 << 53))
    rows = docs.select("*", F.coalesce(docs[text_col].cast("string"), F.lit("")).alias(names["text"]), u.alias(names["u"]))
    rows = held(rows, names["words"], words_of(c["text"]))
    rows = held(rows, names["hashes"], F.transform(c["words"], lambda w: F.xxhash64(w)))
    n, chars = F.size(c["words"]).cast("bigint"), F.length(c["text"])
    share = lambda gone: F.length(F.regexp_replace(c["text"], f"{gone}++", "")) / F.greatest(chars, F.lit(1))
    step = lambda x, most: F.floor(F.least(F.lit(float(most)), x)).cast("int")
    least = [F.coalesce(F.pmod(F.array_min(F.transform(c["hashes"], lambda h: h.bitwiseXOR(F.lit(s)))), F.lit(VALUES)).cast("int"), F.lit(0)) for s in _SALTS[:MINS]]
    x = F.array(
        F.pmod(F.xxhash64(F.coalesce(docs[lang_col].cast("string"), F.lit(""))), F.lit(VALUES)).cast("int"),
        step(F.log2(n + 1.0), VALUES - 1),
        step(4 * chars / F.greatest(n, F.lit(1)), VALUES - 1),
        step(20 * share("[^A-Z]"), 19),
        step(20 * share(r"[A-Za-z .,\n]"), 19),
        *least,
    )
    source = F.coalesce(docs[source_col].cast("string"), F.lit(""))
    kept = [F.col(f"`{k}`") for k in keep if k.lower() not in RESULTS]
    table = rows.select(*kept, n.alias(names["n"]), x.alias(names["x"]), c["u"], source.alias(names["source"]))
    return Described(cut(table), names["n"], names["x"], names["u"], names["source"])


def _tables(counts: list, domains: int, smooth: float) -> list[list[list[float]]]:
    """Log likelihoods [number][value][domain] from counted rows (number, value, domain, n)."""
    kinds = max((r[0] for r in counts), default=-1) + 1
    seen = [[[0.0] * domains for _ in range(VALUES)] for _ in range(kinds)]
    for j, v, d, n in counts:
        seen[j][v][d] += n
    out = []
    for of_kind in seen:
        used = max(1, sum(any(row) for row in of_kind))
        total = [sum(row[d] for row in of_kind) for d in range(domains)]
        out.append([[log((row[d] + smooth) / (total[d] + smooth * used)) for d in range(domains)] for row in of_kind])
    return out


def _evidence(x: str, tables: list[list[list[float]]], domains: int) -> Column:
    """Sum of the log likelihoods of a row's numbers, for each domain."""
    model = _literal(tables, "array<array<array<double>>>")
    rows = F.transform(F.col(f"`{x}`"), lambda v, j: F.get(F.get(model, j), v))
    return F.aggregate(rows, F.array_repeat(F.lit(0.0), domains), lambda a, row: F.zip_with(a, row, _add))


def _normal(logs: Column) -> Column:
    """Probabilities from logarithms up to a constant."""
    shifted = F.transform(F.array(logs), lambda a: F.transform(a, lambda y: F.exp(y - F.array_max(a))))
    return F.transform(shifted, lambda e: F.transform(e, lambda y: y / F.aggregate(e, F.lit(0.0), _add)))[0]


@dataclass(frozen=True)
class Membership:
    table: DataFrame
    p: str  # posterior over the domains, in their order
    domains: list[str]
    weight: float  # of the text's evidence
    held_out: dict[str, float]  # rows, accuracy, and log loss of the prior and of the classifier, on the fold left out


def memberships(told: Described, doubt: float | None = None, smooth: float = 1.0) -> Membership:
    rows, source = told.table, F.col(f"`{told.source}`")
    largest = rows.where(source != "").groupBy(source.alias("s")).agg(F.sum(F.col(f"`{told.n}`")).alias("w")).orderBy(F.desc("w"), "s")
    domains = [r[0] for r in largest.limit(MAX_DOMAINS + 1).collect()]
    if folded := len(domains) > MAX_DOMAINS:
        domains = [*{*domains[: MAX_DOMAINS - 1], OTHERS}]
    domains = sorted(domains) or [""]
    size, in_order = len(domains), _literal(domains, "array<string>")
    own = F.when((source == "") | F.array_contains(in_order, source), source).otherwise(OTHERS) if folded else source
    label = F.when(own != "", F.array_position(in_order, own).cast("int") - 1)
    y, fold, lp, p = (free_name(rows, k) for k in ("__y", "__fold", "__lp", "__p"))
    rows = rows.select("*", label.alias(y), F.pmod(F.xxhash64(told.u), F.lit(FOLDS)).cast("int").alias(fold))
    known = rows.where(F.col(y).isNotNull())
    spread = known.select(y, (F.col(fold) == 0).alias("out"), F.posexplode(F.col(f"`{told.x}`")).alias("j", "v"))
    # The model itself: at most numbers * VALUES * MAX_DOMAINS counts, twice.
    counts = spread.groupBy("j", "v", F.col(y).alias("d"), "out").agg(F.count("*").alias("n")).collect()
    prior = lambda took: [log((sum(r["n"] for r in took if r["j"] == 0 and r["d"] == d) + smooth) / (sum(r["n"] for r in took if r["j"] == 0) + smooth * size)) for d in range(size)]
    as_rows = lambda took: [(r["j"], r["v"], r["d"], r["n"]) for r in took]
    inside = [r for r in counts if not r["out"]]
    weight, told_of = 1.0, {"rows": 0.0}
    if size > 1 and inside:
        base = _literal(prior(inside), "array<double>")
        out = held(known.where(F.col(fold) == 0), lp, _evidence(told.x, _tables(as_rows(inside), size, smooth), size))
        at = lambda w: _normal(F.zip_with(base, F.col(f"`{lp}`"), lambda a, b: a + w * b))
        right = F.array_position(F.col(f"`{lp}`"), F.array_max(f"`{lp}`")).cast("int") - 1 == F.col(y)
        loss = [F.avg(-F.log(F.get(at(w), F.col(y)))).alias(f"l{k}") for k, w in enumerate(WEIGHTS)]
        r = out.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("right"), *loss).first()
        if r["n"]:
            best = min(range(len(WEIGHTS)), key=lambda k: r[f"l{k}"])
            weight, told_of = WEIGHTS[best], {"rows": float(r["n"]), "accuracy": r["right"], "prior_loss": r["l0"], "loss": r[f"l{best}"]}
    base = _literal(prior(counts), "array<double>")
    logs = F.zip_with(base, _evidence(told.x, _tables(as_rows(counts), size, smooth), size), lambda a, b: a + weight * b) if counts else F.array(F.lit(0.0))
    if doubt is not None and size > 1:
        sure, unsure = F.lit(log(1 - doubt)), F.lit(log(doubt / (size - 1)))
        logs = F.transform(logs, lambda a, d: a + F.when(F.col(y).isNull(), 0.0).when(F.col(y) == d, sure).otherwise(unsure))
    return Membership(cut(held(rows, lp, logs).withColumn(p, _normal(F.col(f"`{lp}`"))).drop(lp, y, fold)), p, domains, weight, told_of)


def targets(mass: list[float], wish: list[float], total: float | None, repeat: float | None = None) -> list[float]:
    """Words wanted of each domain: ``total``, or the masses' sum if it is None, by the wishes, with at most ``repeat`` times
    its mass of each domain."""
    most = [inf if repeat is None else m * repeat for m in mass]
    left, target = sum(mass) if total is None else total, [0.0] * len(mass)
    open_to = {i for i, w in enumerate(wish) if w > 0}
    while open_to:
        share = sum(wish[i] for i in open_to)
        full = {i for i in open_to if wish[i] / share * left >= most[i]}
        for i in full or open_to:
            target[i] = most[i] if full else wish[i] / share * left
        if not full:
            break
        left = max(0.0, left - sum(most[i] for i in full))
        open_to -= full
    return target


def _rate(p: str, moved: Sequence[float]) -> Column:
    dot = F.aggregate(F.zip_with(F.col(f"`{p}`"), _literal(list(moved), "array<double>"), lambda a, b: a * b), F.lit(0.0), _add)
    return F.greatest(F.lit(0.0), 1 - dot)


def fitted(member: Membership, n_col: str, weights: Mapping[str, float] | None, total: float | None, temper: float, hold: float, rounds: int, tolerance: float, repeat: float | None) -> tuple[Column, list[float], list[float]]:
    """Rates of the rows as an expression of their posterior, and the words wanted and expected of each domain."""
    size, n = len(member.domains), F.col(f"`{n_col}`")

    def totals(rate: Column) -> list[float]:
        rated = member.table.select((rate * n).alias("w"), F.col(f"`{member.p}`").alias("p"))
        return [float(x or 0.0) for x in rated.agg(*[F.sum(F.col("w") * F.get("p", F.lit(d))).alias(f"s{d}") for d in range(size)]).first()]

    mass = totals(F.lit(1.0))
    wish = [float(weights.get(d, 0.0)) for d in member.domains] if weights is not None else [m**temper for m in mass]
    moved = [0.0] * size
    if sum(wish) <= 0 or sum(mass) <= 0:
        return F.lit(1.0), mass, mass
    target, now, pace = targets(mass, wish, total, repeat), mass, 1 / (1 + hold)
    for _ in range(rounds):
        step = [pace * ((s - t) / m - hold * v) if m > 0 else 0.0 for s, t, m, v in zip(now, target, mass, moved, strict=True)]
        moved = [v + s for v, s in zip(moved, step, strict=True)]
        if max(map(abs, step)) <= tolerance:
            break
        now = totals(_rate(member.p, moved))
    return _rate(member.p, moved), target, now


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang", keep: Sequence[str] | None = None, doubt: float | None = None, temper: float = 0.5, hold: float = 0.02, rounds: int = 20, tolerance: float = 1e-3, repeat: float | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs``, all if it is None, with ``RESULTS``; ``domain`` is the likeliest."""
    told = described(docs, docs.columns if keep is None else keep, id_col, text_col, source_col, lang_col)
    member = memberships(told, doubt)
    (rate, target, expected), p = fitted(member, told.n, weights, total, temper, hold, rounds, tolerance, repeat), F.col(f"`{member.p}`")
    of_domain = lambda told_, kind: F.element_at(_literal(told_, f"array<{kind}>"), F.array_position(p, F.array_max(p)).cast("int"))
    likeliest, whole = of_domain(member.domains, "string"), lambda x: [round(v) for v in x]
    rated = held(member.table, free := free_name(member.table, "__rate"), rate)
    r = F.col(f"`{free}`")
    mixed = rated.withColumns({"n_words": F.col(f"`{told.n}`"), "domain": likeliest, "rate": r, "copies": F.floor(r + F.col(f"`{told.u}`")).cast("int"), "domain_target": of_domain(whole(target), "bigint"), "domain_expected": of_domain(whole(expected), "bigint")})
    return mixed.drop(told.n, told.x, told.u, told.source, member.p, free)


def kept_words(mixed: DataFrame, by: str = "domain") -> DataFrame:
    """(domain, n_docs, n_words, kept_docs, kept_words): documents left out count in the first two alone, repeats in the last."""
    n = F.col("n_words") * F.col("copies")
    kept = F.sum((F.col("copies") > 0).cast("bigint"))
    return mixed.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), kept.alias("kept_docs"), F.sum(n).alias("kept_words"))


def taken(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as ``copies`` says."""
    return mixed.where("copies > 0").select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(free_name(mixed, "__again"))).select(*[F.col(f"`{c}`") for c in columns])
