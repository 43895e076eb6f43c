"""Linear heads on stored vectors: fitting, cross-validation by groups, scaling of probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, c: float = 1.0, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression with a squared penalty of 1 / c on the weights (not the intercept), by Nesterov steps."""
    n, d = x.shape
    w, b = np.zeros((d, classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    sums = x.sum(axis=0)
    gram = np.block([[x.T @ x, sums[:, None]], [sums[None, :], np.array([[float(n)]])]])  # of the rows and a one: no second table of them
    rate = 1.0 / (0.5 * np.linalg.eigvalsh(gram)[-1] / n + 1.0 / (c * n))
    vw, vb, pw, pb = w.copy(), b.copy(), w, b
    for t in range(1, steps + 1):
        g = (softmax_rows(x @ vw + vb) - target) / n
        w, b = vw - rate * (x.T @ g + vw / (c * n)), vb - rate * g.sum(axis=0)
        m = (t - 1) / (t + 2)
        vw, vb, pw, pb = w + m * (w - pw), b + m * (b - pb), w, b
    return w, b


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of vectors of one length as a matrix of doubles; no object is made for a row."""
    out, at = np.empty((len(column), len(column[0]) if len(column) else 0)), 0
    for chunk in column.chunks:
        out[at : at + len(chunk)] = chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1)
        at += len(chunk)
    return out


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)


def grouped_cv(df: DataFrame, vector: str, label: str, fold: str, grid: list[float], classes: int) -> DataFrame:
    """(c, fold, n, correct, nll) for each penalty and fold: trained outside the fold, measured inside.

    A grid cell is a task: the labelled vectors (a measure set, not the corpus) are dealt to each cell once.
    """
    cells = df.select(F.explode(F.array(*map(F.lit, grid))).alias("c"), vector, label, fold)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, f = np.array(rows[vector].tolist(), dtype=float), rows[label].to_numpy(dtype=int), rows[fold].to_numpy()
        out = []
        for k in sorted(set(f)):
            train, test = f != k, f == k
            if not train.any():
                continue
            mean, spread = standardise(x[train])
            w, b = fit_softmax((x[train] - mean) / spread, y[train], classes, float(rows["c"].iloc[0]))
            p = softmax_rows((x[test] - mean) / spread @ w + b)
            out.append((float(rows["c"].iloc[0]), int(k), int(test.sum()), int((p.argmax(axis=1) == y[test]).sum()), float(-np.log(np.maximum(p[np.arange(len(p)), y[test]], 1e-12)).sum())))
        return pd.DataFrame(out, columns=["c", "fold", "n", "correct", "nll"])

    return cells.groupBy("c").applyInPandas(run, "c double, fold long, n long, correct long, nll double")


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden section on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax_rows(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    low, high, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(80):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def platt(p: np.ndarray, correct: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic map of logits, by Newton steps with halving, on smoothed targets."""
    z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    pos, neg = correct.sum(), len(correct) - correct.sum()
    t = np.where(correct, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    loss = lambda a, b: np.logaddexp(0, a * z + b).sum() - (t * (a * z + b)).sum()
    for _ in range(100):
        q = 1 / (1 + np.exp(-(a * z + b)))
        grad = np.array([((q - t) * z).sum(), (q - t).sum()])
        if np.abs(grad).max() < 1e-10:
            break
        h = q * (1 - q)
        step = np.linalg.solve(np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-12 * np.eye(2), grad)
        size = 1.0
        while loss(a - size * step[0], b - size * step[1]) > loss(a, b) and size > 1e-10:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
    return float(a), float(b)


def merged_decision(rules: DataFrame, head: DataFrame, certain: float = 0.9) -> DataFrame:
    """(doc_id, value, source): the rule where its probability is certain or the head has nothing, else the head."""
    both = rules.join(head.withColumnsRenamed({"value": "h_value", "p": "h_p"}), "doc_id", "full_outer")
    use_rule = F.col("value").isNotNull() & ((F.col("p") >= certain) | F.col("h_value").isNull())
    return both.select("doc_id", F.when(use_rule, F.col("value")).otherwise(F.col("h_value")).alias("value"), F.when(use_rule, "rule").otherwise("head").alias("source"))


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(n, equal, only_a, only_b) of two coders."""
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("equal"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def nested_penalty(df: DataFrame, vector: str, label: str, fold: str, grid: list[float], classes: int) -> DataFrame:
    """(outer, c): for each outer fold the penalty with the least loss in cross-validation over the other folds; ties go to the smaller.

    The last row (outer null) is the median of the choices, which is the penalty of the final fit.
    """
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    chosen = []
    for k in folds:
        inner = grouped_cv(df.where(F.col(fold) != k), vector, label, fold, grid, classes).groupBy("c").agg(F.sum("nll").alias("nll"))
        chosen.append((int(k), float(inner.orderBy("nll", "c").first()["c"])))
    middle = float(np.quantile([c for _, c in chosen], 0.5, method="lower")) if chosen else None
    return df.sparkSession.createDataFrame([*chosen, (None, middle)], "outer long, c double")


def choice_probabilities(df: DataFrame, key: str, option: str, mass: str) -> DataFrame:
    """Adds p: the mass of each option as a share of what its options have together; an even share if they have none."""
    total = df.groupBy(key).agg(F.sum(mass).alias("_t"), F.count("*").alias("_n"))
    return df.join(total, key).withColumn("p", F.when(F.col("_t") > 0, F.col(mass) / F.col("_t")).otherwise(F.lit(1.0) / F.col("_n"))).drop("_t", "_n")


def mixture_decode(emissions: np.ndarray, starts: list[np.ndarray], steps: list[np.ndarray], prior: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(best component, posterior of components, best path in it) of a mixture of masked Markov models over one document."""
    from gatherum.operators.sequence import viterbi

    weights, paths = [], []
    for start, step in zip(starts, steps):
        forward, log_total = start * emissions[0], 0.0
        for t in range(len(emissions)):
            if t:
                forward = (forward @ step) * emissions[t]
            scale = max(forward.sum(), 1e-300)
            forward, log_total = forward / scale, log_total + np.log(scale)
        weights.append(log_total)
        with np.errstate(divide="ignore"):
            paths.append(viterbi(np.log(start), np.log(step), np.log(np.maximum(emissions, 1e-300))))
    score = np.log(np.maximum(prior, 1e-300)) + np.array(weights)
    posterior = softmax_rows(score[None, :])[0]
    best = int(posterior.argmax())
    return best, posterior, paths[best]


def oof_logits(df: DataFrame, key: str, layers: list[str], label: str, fold: str, grid: list[float], classes: int) -> DataFrame:
    """(layer, c, key, label, logits): logits of each row from a head that is fitted outside its fold, for each layer (a vector column) and penalty.

    A cell of the grid and a fold is a task; the labelled vectors, a measure set and not the corpus, are dealt to each once.
    """
    folds = F.array_sort(F.collect_set(fold))
    wide = df.crossJoin(F.broadcast(df.agg(folds.alias("_folds"))))  # one row
    narrow = all(df.schema[v].dataType.simpleString() == "array<float>" for v in layers)
    vector = lambda v: F.col(v).cast("array<float>" if narrow else "array<double>")
    cells = wide.select(key, F.col(label).alias("_y"), F.col(fold).alias("_f"), F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), vector(v).alias("x")) for k, v in enumerate(layers)])).alias("v"), "_folds")
    cells = cells.select(key, "_y", "_f", "v.layer", "v.x", F.explode("_folds").alias("_out")).select("*", F.explode(F.array(*map(F.lit, grid))).alias("c"))

    def run(rows: pa.Table) -> pa.Table:
        plain = lambda name: rows.column(name).to_numpy()
        y, out = plain("_y").astype(int), plain("_f") == plain("_out")
        layer, c = rows.column("layer")[0].as_py(), float(rows.column("c")[0].as_py())
        if out.all() or not out.any():
            return pa.table({n: pa.array([], t) for n, t in (("layer", pa.int32()), ("c", pa.float64()), (key, rows.schema.field(key).type), ("label", pa.int32()), ("logits", pa.list_(pa.float64())))})
        x = vectors_of(rows.column("x"))
        train, test = x[~out], x[out]
        del x
        mean, spread = standardise(train)
        for part in (train, test):
            part -= mean
            part /= spread
        w, b = fit_softmax(train, y[~out], classes, c)
        logits = test @ w + b
        n = len(test)
        return pa.table({
            "layer": pa.array(np.full(n, layer, dtype=np.int32)), "c": pa.array(np.full(n, c)), key: rows.column(key).filter(pa.array(out)), "label": pa.array(y[out].astype(np.int32)),
            "logits": pa.ListArray.from_arrays(pa.array(np.arange(0, n * classes + 1, classes, dtype=np.int32)), pa.array(logits.ravel())),
        })

    return cells.groupBy("layer", "c", "_out").applyInArrow(run, f"layer int, c double, {key} {df.schema[key].dataType.simpleString()}, label int, logits array<double>")


def chosen_cell(logits: DataFrame, tie: float = 0.001) -> DataFrame:
    """(layer, c, nll) of the least mean loss; of cells within ``tie`` of it the smallest penalty, then the lowest layer."""
    highest = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda a, z: a + F.exp(z - highest))
    loss = F.log(total) + highest - F.get("logits", F.col("label"))
    cells = logits.groupBy("layer", "c").agg(F.avg(loss).alias("nll"))
    return cells.join(F.broadcast(cells.agg(F.min("nll").alias("_least")))).where(F.col("nll") <= F.col("_least") + tie).orderBy("c", "layer").limit(1).select("layer", "c", "nll")  # one row


def compressed_scores(df: DataFrame, p: str, correct: str, digits: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, correct, weight): scores as they are written (rounded) and how often each occurs. At most two million and two rows, whatever the table."""
    rows = df.groupBy(F.round(p, digits).alias("p"), F.col(correct).alias("y")).agg(F.count("*").alias("n")).orderBy("p", "y").toArrow()
    return tuple(rows.column(k).to_numpy().astype(float) for k in range(3))  # type: ignore[return-value]


def weighted_temperature(p: np.ndarray, correct: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of binary scores with the least loss, by golden section on its logarithm."""
    q = np.clip(p, 1e-6, 1 - 1e-6)
    z = np.log(q / (1 - q))
    loss = lambda t: float((weight * np.logaddexp(0, np.where(correct > 0, -z, z) / np.exp(t))).sum())
    low, high, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(80):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def weighted_platt(p: np.ndarray, correct: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept as ``platt`` gives them, from scores with weights."""
    q = np.clip(p, 1e-6, 1 - 1e-6)
    z = np.log(q / (1 - q))
    pos, neg = weight[correct > 0].sum(), weight[correct == 0].sum()
    t = np.where(correct > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    loss = lambda a, b: float((weight * (np.logaddexp(0, a * z + b) - t * (a * z + b))).sum())
    a, b = 1.0, 0.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-(a * z + b)))
        grad = np.array([(weight * (q - t) * z).sum(), (weight * (q - t)).sum()])
        if np.abs(grad).max() < 1e-10 * max(1.0, weight.sum()):
            break
        h = weight * q * (1 - q)
        step = np.linalg.solve(np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-12 * np.eye(2), grad)
        size = 1.0
        while loss(a - size * step[0], b - size * step[1]) > loss(a, b) and size > 1e-10:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
    return float(a), float(b)


def joint_decode(df: DataFrame, doc: str, pos: str, probabilities: str, starts: list[list[float]], steps: list[list[list[float]]], prior: list[float]) -> DataFrame:
    """(doc, pos, kind, p_kind, state): the best component of a mixture of masked Markov models for each document, its posterior, and the best path in it.

    A mask is a zero in a component's start or step. A group is one document's rows.
    """
    s, a, w = [np.array(x, dtype=float) for x in starts], [np.array(x, dtype=float) for x in steps], np.array(prior, dtype=float)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(pos)
        kind, posterior, path = mixture_decode(np.array(rows[probabilities].tolist(), dtype=float), s, a, w)
        return pd.DataFrame({doc: rows[doc], pos: rows[pos], "kind": kind, "p_kind": float(posterior[kind]), "state": path})

    name = lambda c: df.schema[c].dataType.simpleString()
    return df.select(doc, pos, probabilities).groupBy(doc).applyInPandas(run, f"{doc} {name(doc)}, {pos} {name(pos)}, kind long, p_kind double, state long")


class ChainCrf:
    """Linear-chain conditional random field over feature vectors: weights of features for each state, and of neighbouring states."""

    def __init__(self, features: int, states: int):
        self.emit, self.step, self.start = np.zeros((features, states)), np.zeros((states, states)), np.zeros(states)

    def _messages(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        n = len(score)
        fwd, bwd = np.empty_like(score), np.zeros_like(score)
        fwd[0] = self.start + score[0]
        for t in range(1, n):
            fwd[t] = np.logaddexp.reduce(fwd[t - 1][:, None] + self.step, axis=0) + score[t]
        for t in range(n - 2, -1, -1):
            bwd[t] = np.logaddexp.reduce(self.step + (score[t + 1] + bwd[t + 1])[None, :], axis=1)
        return fwd, bwd, float(np.logaddexp.reduce(fwd[-1]))

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Negative log likelihood of one sequence and its gradient (features, steps, start)."""
        score = x @ self.emit
        fwd, bwd, total = self._messages(score)
        post = np.exp(fwd + bwd - total)
        post[np.arange(len(y)), y] -= 1
        steps = np.zeros_like(self.step)
        for t in range(len(y) - 1):
            steps += np.exp(fwd[t][:, None] + self.step + (score[t + 1] + bwd[t + 1])[None, :] - total)
            steps[y[t], y[t + 1]] -= 1
        said = self.start[y[0]] + score[np.arange(len(y)), y].sum() + self.step[y[:-1], y[1:]].sum()
        return total - float(said), (x.T @ post, steps, post[0])

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], penalty: float = 0.1, rounds: int = 200, rate: float = 0.1) -> ChainCrf:
        """Least penalised loss by steps of adaptive size. ``sequences`` is a set of labelled documents, a bounded one."""
        weights = [self.emit, self.step, self.start]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for k in range(1, rounds + 1):
            grads = [penalty * w for w in weights]
            for x, y in sequences:
                for g, more in zip(grads, self.loss(x, y)[1]):
                    g += more / len(sequences)
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        from gatherum.operators.sequence import viterbi

        return viterbi(self.start, self.step, x @ self.emit)


def crf_decode(df: DataFrame, doc: str, pos: str, vector: str, model: ChainCrf) -> DataFrame:
    """(doc, pos, state): the best path of each document; the model travels to the executors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(pos)
        return pd.DataFrame({doc: rows[doc], pos: rows[pos], "state": model.decode(np.array(rows[vector].tolist(), dtype=float))})

    name = lambda c: df.schema[c].dataType.simpleString()
    return df.select(doc, pos, vector).groupBy(doc).applyInPandas(run, f"{doc} {name(doc)}, {pos} {name(pos)}, state long")


class MlpHead:
    """A head with one hidden layer (rectified) and weights of classes by the reverse of their share."""

    def __init__(self, width: int, hidden: int, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.weights = [rng.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, (2 / hidden) ** 0.5, (hidden, classes)), np.zeros(classes)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def loss(self, x: np.ndarray, y: np.ndarray, class_weight: np.ndarray, penalty: float = 0.0) -> tuple[float, list[np.ndarray]]:
        """Weighted mean loss and its gradient."""
        w1, b1, w2, b2 = self.weights
        inner = x @ w1 + b1
        h = np.maximum(inner, 0)
        p = softmax_rows(h @ w2 + b2)
        each = class_weight[y] / class_weight[y].sum()
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d *= each[:, None]
        back = (d @ w2.T) * (inner > 0)
        value = float(-(each * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum() + penalty / 2 * ((w1**2).sum() + (w2**2).sum()))
        return value, [x.T @ back + penalty * w1, back.sum(axis=0), h.T @ d + penalty * w2, d.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300, rate: float = 0.01) -> MlpHead:
        share = np.bincount(y, minlength=self.weights[3].shape[0]) / len(y)
        class_weight = np.where(share > 0, 1 / np.maximum(share, 1e-12), 0)
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for k in range(1, rounds + 1):
            for w, g, m, v in zip(self.weights, self.loss(x, y, class_weight, penalty)[1], first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return self


def keyword_baseline(text: Column, classes: dict[str, str], default: str) -> Column:
    """The class whose pattern matches most often in a text, of equal ones the first; the default without a match."""
    counts = F.array(*[F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, p) in enumerate(classes.items())])
    best = F.array_max(counts)
    return F.when(F.coalesce(best["n"], F.lit(0)) > 0, best["name"]).otherwise(F.lit(default))


def last_match_baseline(text: Column, classes: dict[str, str], default: str) -> Column:
    """The class whose pattern has the last match in a text; the default without a match."""
    from gatherum.operators.documents import last_hit
    from gatherum.operators.rules import Rule

    return F.coalesce(last_hit(text, [Rule(name, p) for name, p in classes.items()]), F.lit(default))


def cell_differences(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """(keys, cell, left_value, right_value): cells of two calculations of the same table that differ by more than the tolerance, or are in one only."""
    cells = [c for c in a.columns if c not in keys]
    long = lambda df, out: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).cast("double").alias("v")) for c in cells])).alias("x")).select(*keys, "x.cell", F.col("x.v").alias(out))
    both = long(a, "left_value").join(long(b, "right_value"), [*keys, "cell"], "full_outer")
    same = (F.abs(F.col("left_value") - F.col("right_value")) <= tolerance) | F.col("left_value").eqNullSafe(F.col("right_value"))
    return both.where(~F.coalesce(same, F.lit(False)))
