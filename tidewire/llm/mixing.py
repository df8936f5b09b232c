"""Mixing to target weights with soft membership, in DataFrame operations throughout.

A multinomial naive Bayes over hashed character n-grams (the three characters at the
start and at the end of each word), learnt from the labelled rows, gives each document
posteriors over domains.  Rates r >= 0 then minimise half the sum over domains of

    (sum over documents of r * tokens * posterior - target)**2 / tokens at rate 1

by projected gradient.  A pass tries five steps from the present rates, all clipped at 0
or at ``most``: the plain gradient, the gradient with momentum, and the gradient scaled
by the inverse of the Gram matrix of the domains over the rates that aren't held at a
bound, with three ridges; the one with the smallest sum is taken.  Posteriors are rounded
to multiples of 1 / ``GRID``, so that a pass reads one row (a cell) for each posterior
vector that occurs, with the tokens it stands for, instead of documents, and brings the
driver sums by domain.  Steps are measured by a document's tokens; as posteriors sum to
one, the curvature in that measure is at most one, so the plain gradient of length one
never overshoots and the sum falls with every pass.  Passes end when the totals meet the
targets; where no rates can meet them, when a gradient moves no total; and after
``MOST_PASSES`` in any case.  ``Mix.end`` says which, ``Mix.gap`` what is left.  Cells
keep their rates from pass to pass, so each costs the same; a document's rate follows
from its posteriors and the steps taken, so no table of rates is joined.

Domains are the labels that have a weight (``lang`` in the query: a document's source
leaves no trace in its text, so posteriors over sources would all equal the prior and
no rates could meet a target); all other labels are one further domain of target 0.

Defined cases: null texts and texts without words have no tokens and the prior as
posteriors; rows without a label or an id take part but aren't learnt from; without
labelled rows all rates are 1; weights of labels that no row has are left out, and
where none is left ValueError is raised; repeated rows get equal rates; other columns
are handed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import free_name, written
from tidewire.llm.sampling import class_sample

#: Labelled documents of each domain that the n-grams are learnt from.
SAMPLE_PER_DOMAIN = 2_000
BUCKETS = 4_096
#: A document's evidence is scaled to this many n-grams, so that long texts aren't certain of everything.
EFFECTIVE_GRAMS = 60.0
GRID = 64
#: Share of all tokens that a domain's total may be off its target, and the largest movement of a fit that has ended.
TOLERANCE, STILL = 1e-6, 1e-7
#: Passes of a fit, at most, and passes after which the cells are written anew.
MOST_PASSES, LINEAGE = 200, 4
#: Ridges of the scaled steps, in units of the domains' tokens.
RIDGES = (1e-8, 1e-4, 1e-2)


@dataclass
class Domains:
    """Names (None: all labels without a weight), log priors, and log shares of buckets (domain x bucket)."""

    names: list[str | None]
    prior: np.ndarray
    shares: np.ndarray


@dataclass
class Mix:
    """Steps (a vector, and how far momentum goes before it), the bound of the rates, by how much of all tokens the totals of domains are off their targets, and why passes ended: ``met``, ``still`` or ``passes``."""

    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)
    most: float | None = None
    gap: np.ndarray = field(default_factory=lambda: np.zeros(0))
    end: str = "met"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it and filters are pushed down."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)


def _literal(values: np.ndarray) -> Column:
    """An array of doubles that is one literal in the plan."""
    return F.split(F.lit(",".join(f"{x:.9g}" for x in values)), ",").cast("array<double>")


def _looked_up(places: Column, values: np.ndarray) -> Column:
    """The sum of the values at ``places``."""
    table = _literal(values)
    return F.aggregate(places, F.lit(0.0), lambda t, at: t + table[at])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _grams(words: Column) -> Column:
    """Buckets of the n-grams at the starts and ends of words."""

    def bucket(gram: Column, end: int) -> Column:
        return F.pmod(F.xxhash64(gram, F.lit(end)), F.lit(BUCKETS)).cast("int")

    return F.concat(F.transform(words, lambda w: bucket(F.substring(w, 1, 3), 0)), F.transform(words, lambda w: bucket(F.right(w, F.lit(3)), 1)))


def fit_domains(docs: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", label_col: str = "lang", text_col: str = "text") -> Domains:
    """Learn the domains' n-grams from a sample of the labelled rows, and their priors from all."""
    label = F.col(label_col).cast("string")
    rows = docs.where(label.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label.alias("raw"))
    # labels that have a weight are told from the remainder by their place, so that "" can be a label too
    rows = rows.withColumn("label", F.when(F.col("raw").isin([w for w, x in weights.items() if x > 0]), F.concat(F.lit("w"), F.col("raw"))).otherwise(F.lit("rest"))).drop("raw")
    counts = dict(rows.groupBy("label").agg(F.count("*")).collect())
    names = sorted(counts)
    if names and names == ["rest"]:
        raise ValueError("no domain has a weight")
    seen = np.zeros((len(names), BUCKETS))
    grams = class_sample(rows, "id", "label", SAMPLE_PER_DOMAIN).select("label", F.explode(_grams(_words(F.col("text")))).alias("bucket"))
    for name, bucket, n in grams.groupBy("label", "bucket").agg(F.count("*")).collect():
        seen[names.index(name), bucket] = n
    shares = np.log((seen + 0.5) / (seen + 0.5).sum(axis=1, keepdims=True))
    many = np.array([counts[x] for x in names], dtype=float)
    return Domains([None if x == "rest" else x[1:] for x in names], np.log(many / max(many.sum(), 1.0)), shares)


def membership(domains: Domains, text: Column) -> Column:
    """A struct of tokens (words) and parts, the posteriors as whole multiples of 1 / GRID (about; their sum is the unit)."""
    n = len(domains.names)

    def posteriors(grams: Column) -> Column:
        scale = F.least(F.lit(1.0), F.lit(EFFECTIVE_GRAMS) / F.greatest(F.size(grams), F.lit(1)))
        # logits against the first domain: a softmax knows no more
        evidence = [_looked_up(grams, domains.shares[d] - domains.shares[0]) for d in range(1, n)]
        logits = F.array(F.lit(0.0), *(F.lit(float(domains.prior[d] - domains.prior[0])) + e * scale for d, e in enumerate(evidence, 1)))
        odds = _let(logits, lambda own: _let(F.array_max(own), lambda best: F.transform(own, lambda x: F.exp(x - best))))
        return _let(odds, lambda o: _let(_sum(o), lambda t: F.transform(o, lambda x: F.round(x / t * GRID).cast("int"))))

    if not n:
        return _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("tokens"), F.array().cast("array<int>").alias("parts")))
    return _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("tokens"), _let(_grams(w), posteriors).alias("parts")))


def member_table(docs: DataFrame, domains: Domains, *, id_col: str = "doc_id", label_col: str = "lang", text_col: str = "text") -> DataFrame:
    """doc_id, label, tokens, parts of each document, written once: no later pass reads the texts."""
    own = membership(domains, F.col(text_col)).alias("m")
    return written(docs.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("string").alias("label"), own).select("doc_id", "label", "m.*"), "mix-members")


def _moved(p: Column, rate: Column, before: Column, step: Column, push: Column, most: float | None) -> Column:
    """The rate after a step against ``step`` (an array by domain) from where momentum leads, within the bounds."""
    new = F.greatest(F.lit(0.0), rate + push * (rate - before) - _sum(F.zip_with(p, step, lambda x, y: x * y)))
    return new if most is None else F.least(F.lit(float(most)), new)


def _state(mix: Mix, p: Column) -> Column:
    """From posteriors, a struct of the rate that the steps lead to and of the rate before the last."""
    n = len(mix.steps[0][0])
    flat = _literal(np.concatenate([[*step, push] for step, push in mix.steps]))

    def moved(own: Column, k: Column) -> Column:
        at = k * (n + 1)
        return F.struct(_moved(p, own["rate"], own["before"], F.slice(flat, at + 1, F.lit(n)), flat[at + n], mix.most).alias("rate"), own["rate"].alias("before"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(mix.steps) - 1)), F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("before")), moved)


def _rate(mix: Mix, parts: Column) -> Column:
    """The rate that the steps so far lead to."""
    return _let(_let(_shares(parts), lambda p: _state(mix, p)), lambda own: own["rate"]) if mix.steps else F.lit(1.0)


def _shares(parts: Column) -> Column:
    """Posteriors of whole parts."""
    return _let(F.aggregate(parts, F.lit(0), lambda t, x: t + x), lambda t: F.transform(parts, lambda x: x / t))


def fit_mix(members: DataFrame, domains: Domains, weights: dict[str, float], *, budget: float | None = None, most: float | None = None) -> Mix:
    """Fit the rates on a table with the columns tokens and parts.

    ``budget`` is the total of tokens wanted; where it is None, the largest that the
    weights allow without repeating a document.  ``most`` bounds the rates above.
    """
    mix = Mix([], most)
    n = len(domains.names)
    cells = written(members.where("tokens > 0").groupBy("parts").agg(F.sum("tokens").cast("double").alias("tokens")), "mix-cells")
    cells = cells.select("tokens", _shares(F.col("parts")).alias("p"), F.lit(1.0).alias("rate"), F.lit(1.0).alias("before"))
    wanted = np.array([0.0 if d is None else max(0.0, weights[d]) for d in domains.names])
    if not n or cells.isEmpty():
        return mix
    p, tokens, rate, before = (F.col(x) for x in ("p", "tokens", "rate", "before"))

    def sums(*values: Column) -> np.ndarray:
        """The sums over the cells of arrays' places, one array after the other."""
        placed = cells.select(F.posexplode(F.flatten(F.array(*values)))).groupBy("pos").agg(F.sum("col").alias("s"))
        return np.array([r["s"] for r in sorted(placed.collect())])

    def at_rate(own: Column) -> Column:
        """Tokens of a cell by domain at a rate."""
        return _let(tokens * own, lambda t: F.transform(p, lambda x: t * x))

    def height(off: np.ndarray) -> float:
        return float((off * off * weight).sum())

    whole = sums(at_rate(F.lit(1.0)))
    weight = 1 / np.maximum(whole, 1e-300)
    wanted /= wanted.sum()
    asked = wanted > 0
    target = wanted * (budget if budget is not None else float((whole[asked] / wanted[asked]).min()))
    unit = max(float(target.sum()), 1e-300)
    t = 1.0
    if most is not None and most < 1:  # rates begin within their bound
        mix.steps.append((np.full(n, 1.0 - most), 0.0))
        cells = cells.withColumn("rate", F.lit(float(most)))
        now = whole * most
    else:
        now = whole
    while True:
        off = now - target
        mix.gap = off / unit
        if np.abs(mix.gap).max() < TOLERANCE:
            return mix
        if len(mix.steps) >= MOST_PASSES:
            mix.end = "passes"
            return mix
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        push = (last - 1) / t
        slope = _sum(F.zip_with(p, _literal(weight * off), lambda x, y: x * y))
        held = (rate <= 0) & (slope > 0)
        if most is not None:
            held = held | ((rate >= float(most)) & (slope < 0))
        free = F.when(held, 0.0).otherwise(tokens)
        ahead = at_rate(rate + F.lit(float(push)) * (rate - before))
        got = sums(_let(free, lambda f: F.flatten(F.transform(p, lambda x: F.transform(p, lambda y: f * x * y)))), ahead)
        gram, there = got[: n * n].reshape(n, n), got[n * n :]
        root = np.sqrt(weight)
        scaled = root[:, None] * gram * root
        steps = [(root * np.linalg.solve(scaled + ridge * np.eye(n), root * off), 0.0) for ridge in RIDGES]
        steps += [(weight * off, 0.0), (weight * (there - target), push)]

        def after(step: np.ndarray, push: float) -> Column:
            return _moved(p, rate, before, _literal(step), F.lit(float(push)), most)

        totals = sums(*(at_rate(after(*s)) for s in steps)).reshape(len(steps), n)
        heights = [height(x - target) for x in totals]
        best = int(np.argmin(heights))
        if np.abs(totals[len(RIDGES)] - now).max() / unit < STILL or heights[best] >= height(off):
            mix.end = "still"
            return mix
        if best != len(steps) - 1:
            t = 1.0
        mix.steps.append(steps[best])
        now = totals[best]
        cells = cells.select("tokens", "p", after(*steps[best]).alias("rate"), rate.alias("before"))
        if len(mix.steps) % LINEAGE == 0:
            cells = written(cells, "mix-cells")


def rates(members: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, label, tokens, rate of a member table's rows."""
    return members.select("doc_id", "label", "tokens", _rate(mix, F.col("parts")).alias("rate"))


def mixed(docs: DataFrame, weights: dict[str, float], *, budget: float | None = None, most: float | None = None, id_col: str = "doc_id", label_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` drawn at their rates: the whole part as copies, the rest by a hash of the id.

    The rows are written with their membership, so that texts are read once for it.
    """
    domains = fit_domains(docs, weights, id_col=id_col, label_col=label_col, text_col=text_col)
    name = free_name(docs, "__tw_member")
    held = written(docs.withColumn(name, membership(domains, F.col(text_col))), "mix-rows")
    mix = fit_mix(held.select(F.col(f"{name}.tokens").alias("tokens"), F.col(f"{name}.parts").alias("parts")), domains, weights, budget=budget, most=most)
    unit = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(29)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = _let(_rate(mix, F.col(f"{name}.parts")), lambda r: F.floor(r) + (unit < r - F.floor(r)).cast("int"))
    if most is not None and most <= 1:
        return held.where(copies >= 1).drop(name)
    again = free_name(held, "__tw_copy")
    return held.withColumn(again, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).drop(name, again)
