"""URL filters: rules first, then gradient-boosted trees on lexical features. DataFrame functions only.

Trees are grown level by level: one aggregation over the training rows gives the gradient histograms of
all nodes and features, a window adds them up, and the best split of each node comes to the driver (at
most 2^depth rows). A trained model is a plain column expression, so scoring stays in generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query: (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A page is labelled bad by its text: runs of marks, or a title in capitals.
JUNK, MANY_JUNK, SHOUTED = r"[#*$%&]{3,}", 3, r"(?is)<title>(?-i:[^a-z<]{20,})</title>|(?-i:<title>[^a-z<]{20,})"
FOLDS = 5  # a training row's suffix statistics come from the folds it isn't in

TRAIN_ROWS = 20_000  # labelled URLs used for training, at most
TREES, DEPTH, BINS, RATE, RIDGE = 8, 3, 16, 0.5, 1.0
SMOOTHING = 20.0
NUMERIC = ("length", "host_length", "path_length", "depth", "digit_ratio", "hyphens", "labels", "host_entropy", "path_entropy", "parameters", "fragment")
SUFFIXES = ("suffix1", "suffix2", "suffix3")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest fitting (rule, verdict), else null. Rules are a short list; they become one expression."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one that fits wins
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits a character of a text's characters; 0 for an empty one."""
    n = F.length(text)
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(each, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds host, path and the lexical features to rows with a column `url`; null counts as empty."""
    text = F.coalesce(F.col("url"), F.lit(""))
    step = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "query": F.regexp_extract(text, r"(?s)\?([^#]*)", 1)})
    count = lambda c, what: (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))).cast("double")
    return step.withColumns({
        "length": F.length(text).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/"), "digit_ratio": F.when(F.length(text) > 0, (F.length(text) - F.length(F.translate(text, "0123456789", ""))) / F.length(text)).otherwise(0.0),
        "hyphens": count(F.col("host"), "-"), "labels": count(F.col("host"), ".") + 1, "host_entropy": entropy(F.col("host")), "path_entropy": entropy(F.col("path")),
        "parameters": F.when(F.col("query") == "", 0.0).otherwise(count(F.col("query"), "&") + 1), "fragment": text.contains("#").cast("double"),
        **{s: F.substring_index("host", ".", -(k + 1)) for k, s in enumerate(SUFFIXES)},
    })


@dataclass
class UrlModel:
    suffixes: DataFrame  # suffix, rate, seen: at most three rows for each training row
    edges: list[list[float]]  # of each feature's bins
    trees: list[dict]  # {"f", "bin", "low", "high"} or {"value"}
    prior: float
    names: tuple[str, ...]

    def features(self, rows: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        """Rows with lexical features and the suffix statistics (by fold, where `stats` has folds).

        The training bound makes the table broadcastable: three rows for each training row at most.
        """
        stats = self.suffixes if stats is None else stats
        for s in SUFFIXES:
            renamed = stats.withColumnsRenamed({"suffix": s, "rate": f"{s}_rate", "seen": f"{s}_seen"})
            rows = rows.join(F.broadcast(renamed), [s, "fold"] if "fold" in stats.columns else s, "left")
        return rows.fillna(self.rate, [f"{s}_rate" for s in SUFFIXES]).fillna(0.0, [f"{s}_seen" for s in SUFFIXES])

    @property
    def rate(self) -> float:
        return 1 / (1 + math.exp(-self.prior))

    def margin(self) -> Column:
        def value(tree: dict) -> Column:
            if "value" in tree:
                return F.lit(tree["value"])
            cut = self.edges[tree["f"]][tree["bin"]]
            return F.when(F.col(self.names[tree["f"]]) <= cut, value(tree["low"])).otherwise(value(tree["high"]))

        return reduce(add, [value(t) for t in self.trees], F.lit(self.prior))

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Trains on distinct labelled URLs (columns url, label 0 or 1), at most `train_rows` in order of a hash.

    Rows with a null url or label don't count. Without rows, or with labels of one kind, every score is
    that of the prior.
    """
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(F.col("url").cast("string").alias("url"), F.col("label").cast("double").alias("label")).distinct()
    sample = materialize(lexical(bounded_sample(rows, train_rows, "url", "label")).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")), "urls")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    rate = (positive + 0.5) / (n + 1)
    prior = math.log(rate / (1 - rate))
    suffix = F.explode(F.array_distinct(F.array(*SUFFIXES)))
    each = sample.select(suffix.alias("suffix"), "label", "fold").groupBy("suffix", "fold").agg(F.sum("label").alias("bad"), F.count("*").cast("double").alias("n"))
    told = lambda bad, n: [((bad + SMOOTHING * rate) / (n + SMOOTHING)).alias("rate"), F.log1p(n).alias("seen")]
    each = materialize(each, "suffix-folds")
    whole = each.groupBy("suffix").agg(F.sum("bad").alias("bad_all"), F.sum("n").alias("n_all"))
    names = NUMERIC + tuple(f"{s}_{x}" for s in SUFFIXES for x in ("rate", "seen"))
    model = UrlModel(materialize(whole.select("suffix", *told(F.col("bad_all"), F.col("n_all"))), "suffixes"), [], [], prior, names)
    # A row must not see its own label: it gets the statistics of the other folds.
    others = each.join(whole, "suffix").select("suffix", "fold", *told(F.col("bad_all") - F.col("bad"), F.col("n_all") - F.col("n")))
    full = model.features(sample, materialize(others, "other-folds"))
    steps = [k / BINS for k in range(1, BINS)]
    cuts = full.agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in names]).first()
    model.edges = [sorted(set(cuts[c] or [])) for c in names]
    bins = [reduce(add, [(F.col(c) > e).cast("int") for e in edges], F.lit(0)) for c, edges in zip(names, model.edges)]
    train = materialize(full.groupBy(F.array(*bins).alias("bins"), "label").agg(F.count("*").cast("double").alias("w")), "bins")
    if 0 < positive < n:
        for _ in range(trees):
            model.trees.append(_grow(train, model, depth))
    return model


def _binned(tree: dict, then) -> Column:
    """A tree over bins; `then` makes a leaf's column."""
    if "f" not in tree:
        return then(tree)
    return F.when(F.get("bins", F.lit(tree["f"])) <= tree["bin"], _binned(tree["low"], then)).otherwise(_binned(tree["high"], then))


def _grow(train: DataFrame, model: UrlModel, depth: int) -> dict:
    margin = reduce(add, [_binned(t, lambda leaf: F.lit(leaf["value"])) for t in model.trees], F.lit(model.prior))
    p = 1 / (1 + F.exp(-margin))
    rows = train.select("bins", ((p - F.col("label")) * F.col("w")).alias("g"), (p * (1 - p) * F.col("w")).alias("h"))
    root: dict = {"node": 0}
    leaves = [root]
    below = Window.partitionBy("node", "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "f")
    for level in range(depth + 1):
        node = _binned(root, lambda leaf: F.lit(leaf["node"]))
        cells = rows.select(node.alias("node"), F.posexplode("bins").alias("f", "bin"), "g", "h").groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        sums = cells.select("node", "f", "bin", F.sum("g").over(below).alias("gl"), F.sum("h").over(below).alias("hl"), F.sum("g").over(whole).alias("gt"), F.sum("h").over(whole).alias("ht"))
        part = lambda g, h: g * g / (h + RIDGE)
        gain = part(F.col("gl"), F.col("hl")) + part(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - part(F.col("gt"), F.col("ht"))
        best = F.max(F.struct(F.round(gain, 9).alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"))).alias("best")
        found = {r.node: r for r in sums.groupBy("node").agg(best, F.max("gt").alias("g"), F.max("ht").alias("h")).collect()}
        nodes, leaves = leaves, []
        for leaf in nodes:
            r = found.get(leaf["node"])
            if r is None or level == depth or r.best.gain <= 1e-6:
                leaf["value"] = -RATE * r.g / (r.h + RIDGE) if r else 0.0
                leaf["node"] = -1 - leaf["node"]
                continue
            leaf |= {"f": -r.best.f, "bin": -r.best.bin, "low": {"node": 2 * leaf["node"] + 1}, "high": {"node": 2 * leaf["node"] + 2}}
            leaves += [leaf["low"], leaf["high"]]
        if not leaves:
            break
    return root


def page_labels(pages: DataFrame) -> DataFrame:
    """Labelled URLs for the query, by the text of their pages alone: 1 for junk or a shouted title, else 0. A null html gives no label."""
    bad = (F.regexp_count("html", F.lit(JUNK)) >= MANY_JUNK) | F.col("html").rlike(SHOUTED)
    return pages.select("url", bad.cast("int").alias("label"))


def held_out(pages: DataFrame, part: int = FOLDS) -> Column:
    """Whether a url is in the one of `part` parts by hash that a measurement keeps from training."""
    return F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(part)) == 0


def area(scored: DataFrame) -> float | None:
    """Area under the ROC curve of rows (score, label): the chance that a row of label 1 scores above one of label 0, ties half.

    Rows are counted by score first, so the window runs over distinct scores: a tree model has few.
    """
    counts = scored.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = counts.select("p", "n", (F.col("p") * (below + F.col("n") / 2)).alias("won")).agg(F.sum("won"), F.sum("p"), F.sum("n")).first()
    return total[0] / (total[1] * total[2]) if total[1] and total[2] else None


def judge(pages: DataFrame, model: UrlModel, rules=RULES, limit: float = 0.5) -> DataFrame:
    """Judges every url: page_id, host, path, rule, verdict, score.

    A null url or one without :// has an empty host and path, fits no rule, and goes by its score like
    any other. Repeated rows all stay; an empty table gives no rows.
    """
    rows = lexical(pages.select("page_id", F.col("url").cast("string").alias("url")))
    scored = model.features(rows).withColumn("score", F.round(model.score(), 9)).withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("score") >= limit, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), method).alias("verdict"), "score")
