"""Secret scans: fixed patterns, and a character convolutional network over everything that could be a secret.

Candidates are runs of key characters, at least ``SHORTEST`` long, that the patterns have not found as a whole. The network
sees the candidate with the text before and behind it, as classes of characters; over a long one it slides in windows
that overlap by half, and the highest score counts. It is an embedding, convolution, maximum
over places, logistic output. It is written in numpy and trained on all labelled findings: a few thousand in one task; more
are dealt to as many tasks as they need, which train side by side and whose networks are averaged after every round.
On findings it was not trained on, its output is calibrated (a logistic fit of label on output), and the
threshold is the highest one that still finds the demanded share of the true secrets among them, made ones and the patterns'
own: it says nothing of other forms. Spans it adds are of kind ``model``;
those of the patterns always stay.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tongueprint.llm.common import map_rows, text_or_empty
from tongueprint.session import materialize

# The patterns of the contract with the shortest match (of group 2, if there is one) that counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (
    ("assign", re.compile(ASSIGN, re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
# Runs that are too short cannot match later either, so they are skipped at once; the matches are the same.
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "model")
SHORTEST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=@-]{12,}")

BEFORE, INSIDE, BEHIND = 24, 40, 8
WINDOW = BEFORE + INSIDE + BEHIND
WIDTH, DEPTH, FILTERS = 5, 8, 16
CLASSES = 96


# Rounds after which networks trained side by side are averaged.
ROUNDS = 4
# Calibration counts outputs in bins of this width, up to this many on either side.
BIN, BINS = 0.05, 1200


@dataclass(frozen=True)
class Training:
    """``rows``: made findings a task adds, and about how many of the given ones it takes."""

    rows: int = 4_000
    epochs: int = 12
    rate: float = 0.01
    recall: float = 0.99
    seed: int = 11


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the patterns by start, then kind in the order listed."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind == "assign":
            lower = text.lower()
            if not any(word in lower for word in KEYWORDS):
                continue
        searched = LONG_HEX if kind == "hex" else pattern
        for match in searched.finditer(text):
            if match.end(group) - match.start(group) >= least:
                found.append((match.start(), order, match.end(), kind))
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def candidates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs that the spans of the patterns do not cover as a whole."""
    covered: list[list[int]] = []
    for start, end, _ in spans:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    out, following = [], 0
    for match in CANDIDATE.finditer(text):
        while following < len(covered) and covered[following][1] < match.end():
            following += 1
        if following == len(covered) or covered[following][0] > match.start():
            out.append(match.span())
    return out


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate as parts of at most ``INSIDE`` characters that overlap by half or more; the last one ends where it ends."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of a piece of a candidate between its surroundings; 0 is padding."""
    inside = text[start:end]
    cut = text[max(0, start - BEFORE):start].rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0") + text[end:end + BEHIND].ljust(BEHIND, "\0")
    codes = np.frombuffer(cut.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(codes == 0, 0, np.where(codes > 126, 1, np.where(codes < 32, 2, codes - 31 + 1))).astype(np.int16) % CLASSES


class Network:
    """Embedding, one convolution with ReLU, maximum and mean over places, logistic output."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.weights = {
            "embed": draw.normal(0, 0.3, (CLASSES, DEPTH)), "filter": draw.normal(0, 0.2, (WIDTH * DEPTH, FILTERS)),
            "shift": np.zeros(FILTERS), "out": draw.normal(0, 0.2, 2 * FILTERS), "bias": np.zeros(1),
        }

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        places = WINDOW - WIDTH + 1
        columns = np.stack([windows[:, i:i + places] for i in range(WIDTH)], axis=2)
        seen = w["embed"][columns].reshape(len(windows), places, WIDTH * DEPTH)
        active = np.maximum(0.0, seen @ w["filter"] + w["shift"])
        top = active.argmax(1)
        pooled = np.concatenate([np.take_along_axis(active, top[:, None], 1)[:, 0], active.mean(1)], axis=1)
        return pooled @ w["out"] + w["bias"], (columns, seen, active, top, pooled)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        logits, (columns, seen, active, top, pooled) = self.forward(windows)
        error = (logistic(logits) - labels) / len(labels)
        back = error[:, None] * w["out"]
        flow = np.repeat(back[:, None, FILTERS:] / active.shape[1], active.shape[1], axis=1)
        rows, filters = np.arange(len(labels))[:, None], np.arange(FILTERS)[None]
        flow[rows, top, filters] += back[:, :FILTERS]
        flow *= active > 0
        embed = np.zeros_like(w["embed"])
        np.add.at(embed, columns, (flow @ w["filter"].T).reshape(*columns.shape, DEPTH))
        return {
            "embed": embed, "filter": np.einsum("npc,npf->cf", seen, flow), "shift": flow.sum((0, 1)), "out": error @ pooled,
            "bias": error.sum(keepdims=True),
        }


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


@dataclass(frozen=True)
class Scanner:
    """A trained network with its calibration, threshold, and the share of true held-out findings it keeps (null without any)."""

    network: Network
    slope: float
    shift: float
    threshold: float
    recall: float | None

    def scores(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.network.forward(windows[i:i + 1024])[0] for i in range(0, len(windows), 1024)]
        return logistic(self.slope * np.concatenate([*parts, np.zeros(0)]) + self.shift)


def fit(windows: np.ndarray, labels: np.ndarray, training: Training) -> Scanner:
    """Train on four fifths of the findings; calibrate and set the threshold on the rest."""
    draw = np.random.default_rng(training.seed)
    order = draw.permutation(len(labels))
    held, used = order[: len(order) // 5], order[len(order) // 5:]
    network = Network(training.seed)
    descend(network, windows, labels, used, training.epochs, training.rate, draw)
    logits = network.forward(windows[held])[0]
    slope, shift = calibration(logits, labels[held], np.ones(len(held)))
    scores = np.sort(logistic(slope * logits[labels[held] == 1] + shift))
    missed = int(np.floor((1.0 - training.recall) * len(scores)))
    threshold = float(scores[missed]) if len(scores) else 0.5
    return Scanner(network, slope, shift, threshold, float(np.mean(scores >= threshold)) if len(scores) else None)


def descend(
    network: Network, windows: np.ndarray, labels: np.ndarray, used: np.ndarray, epochs: int, rate: float, draw: np.random.Generator
) -> None:
    """Epochs of Adam over the windows ``used``; the network changes in place."""
    step = 0
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    for _ in range(epochs):
        for start in range(0, len(used), 64):
            some, step = used[start:start + 64], step + 1
            for name, gradient in network.gradients(windows[some], labels[some]).items():
                first[name] = 0.9 * first[name] + 0.1 * gradient
                second[name] = 0.999 * second[name] + 0.001 * gradient**2
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                network.weights[name] = network.weights[name] - rate * move
        used = draw.permutation(used)


def calibration(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of label on output, by plain gradient steps on two numbers."""
    slope, shift = 1.0, 0.0
    for _ in range(200):
        error = logistic(slope * logits + shift) - labels
        slope -= 0.05 * float(np.average(error * logits, weights=counts)) / max(1e-9, float(np.average(logits**2, weights=counts)) ** 0.5)
        shift -= 0.5 * float(np.average(error, weights=counts))
    return slope, shift


def packed(network: Network) -> np.ndarray:
    return np.concatenate([network.weights[n].ravel() for n in sorted(network.weights)])


def unpacked(flat: np.ndarray, seed: int) -> Network:
    network = Network(seed)
    for name in sorted(network.weights):
        size = network.weights[name].size
        network.weights[name], flat = flat[:size].reshape(network.weights[name].shape), flat[size:]
    return network


def labelled(frame: pd.DataFrame) -> list[tuple[np.ndarray, int]]:
    """The windows of given findings."""
    cells = zip(frame["text"], frame["start"], frame["end"], frame["label"])
    return [(window(t, a, b), int(y)) for t, s, e, y in cells for a, b in pieces(int(s), int(e))]


def made_findings(count: int, seed: int) -> list[tuple[np.ndarray, int]]:
    """Labelled findings made by rule: keys of many forms in many settings, and harmless runs of the same characters."""
    draw = random.Random(seed)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    mixed = lower + lower.upper() + digits
    words = "the and report server value order access client number system session private signing database".split()
    run = lambda letters, a, b: "".join(draw.choice(letters) for _ in range(draw.randint(a, b)))
    word = lambda: "".join(draw.choice(["an", "er", "ti", "on", "re", "es", "th", "in", "ou", "st"]) for _ in range(draw.randint(1, 4)))

    def path() -> str:
        return "/".join(word() + draw.choice(["", "", run(digits, 1, 3)]) for _ in range(draw.randint(5, 16)))

    def secret() -> tuple[str, str]:
        before = draw.choice(["pwd = ", "auth: Bearer ", "key=", "credential: ", "private_key = '", "PWD=", "access ", "aws_key: ", ""])
        value = draw.choice([
            lambda: run(mixed, 16, 44), lambda: run(mixed + "+/", 32, 60) + "==", lambda: "ghp_" + run(mixed, 30, 36),
            lambda: "sk-" + run(mixed, 24, 48), lambda: "eyJ" + run(mixed, 20, 30) + "." + run(mixed + "_-", 20, 40),
            lambda: run(lower + digits, 20, 40), lambda: "xoxb-" + run(digits, 10, 12) + "-" + run(mixed, 20, 24),
            lambda: run(lower + lower.upper(), 16, 40), lambda: run(lower, 24, 40), lambda: run(mixed, 6, 14) + run("0123456789abcdef", 16, 20) + run(mixed, 6, 14),
        ])()
        return before, value

    def harmless() -> tuple[str, str]:
        value = draw.choice([
            lambda: f"{word()}.{run(digits, 1, 3)}@{word()}{run(digits, 1, 1)}.example.com", lambda: f"{word()}{word()}.{word()}{run(digits, 1, 2)}",
            lambda: f"www.{word()}.com/{word()}/{run(digits, 1, 4)}", lambda: f"{run(digits, 4, 4)}-{run(digits, 2, 2)}-{run(digits, 2, 2)}T{run(digits, 2, 2)}",
            lambda: f"{word()}-{word()}-{run(digits, 1, 4)}", lambda: run(digits, 12, 15), lambda: f"{word()}_{word()}_{run(digits, 1, 2)}.tar.gz",
            lambda: f"{run(digits, 3, 3)}-{run(digits, 3, 3)}-{run(digits, 4, 4)}", lambda: "=" * draw.randint(8, 20) + run(digits, 1, 3),
            lambda: ".".join(run(digits, 1, 3) for _ in range(4)), lambda: f"{word()}{word()}{word()}{run(digits, 1, 3)}",
            lambda: "".join(word() for _ in range(draw.randint(2, 6))), lambda: "".join(word() for _ in range(3)).capitalize(),
            lambda: "-".join(word() for _ in range(draw.randint(2, 6))), lambda: draw.choice("=-_.") * draw.randint(12, 90), path,
        ])()
        return draw.choice(["", "see ", "on ", "from ", "version "]), value

    out = []
    for i in range(count):
        before, value = secret() if i % 2 else harmless()
        while len(value) < SHORTEST:
            value += draw.choice(digits) if i % 2 or value[-1] in digits else word()
        left = " ".join(draw.choice([draw.choice(words), word()]) for _ in range(5)) + draw.choice([" ", ". ", "\n"]) + before
        right = draw.choice(["", "'", '"', ",", "."]) + " " + word() + " " + word()
        start, end = len(left), len(left) + len(value)
        if i % 8 == 1:  # in the middle of a longer run
            ahead, behind = path() + draw.choice(["/", "=", "/key="]), draw.choice(["/", "/", "="]) + path()
            left, right, start, end = left + ahead, behind + right, start + len(ahead), end + len(ahead)
        out += [(window(left + value + right, a, b), i % 2) for a, b in pieces(start, end)]
    return out


def train(training: Training = Training(), findings: DataFrame | None = None, spark=None) -> Scanner:
    """Fit on made findings and, if given, on all of ``findings (text, start, end, label)``."""
    session = spark if spark is not None else findings.sparkSession
    given = findings if findings is not None else session.createDataFrame([], "text string, start int, `end` int, label int")
    usable = given.where("text is not null and start is not null and `end` is not null and label is not null and start < `end`")
    near = materialize(usable.select("text", "start", "end", "label", F.xxhash64("text", "start").alias("at")), "findings")
    parts = -(-near.count() // training.rows)
    if parts > 1:
        return train_in_parts(near, parts, training)
    # A row without text stands for the made findings, so that the one task runs without given ones too.
    alone = session.range(1).selectExpr("cast(null as string) text", "0 start", "0 as `end`", "0 label", "0L at")
    whole = near.unionByName(alone).repartition(1).sortWithinPartitions("at", "text", "start", "end", "label")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = made_findings(training.rows, training.seed)
        for f in frames:
            rows += labelled(f[f["text"].notna()])
        scanner = fit(np.stack([w for w, _ in rows]), np.array([y for _, y in rows], dtype=float), training)
        flat = packed(scanner.network)
        yield pd.DataFrame({"flat": [flat], "slope": [scanner.slope], "shift": [scanner.shift], "threshold": [scanner.threshold], "recall": [scanner.recall]})

    found = whole.mapInPandas(run, "flat array<double>, slope double, shift double, threshold double, recall double").first()
    network = unpacked(np.asarray(found["flat"]), training.seed)
    return Scanner(network, found["slope"], found["shift"], found["threshold"], found["recall"])


def train_in_parts(near: DataFrame, parts: int, training: Training) -> Scanner:
    """The same over any number of findings: every part adds made findings of its own and holds out a fifth.

    Each round starts all parts from one network and averages theirs by the windows they were trained on. Calibration counts the held-out
    outputs of all parts in bins; the threshold is taken from the outputs themselves.
    """
    # Dealt in turn, so that copies of one finding do not meet in one part; written, so that the parts stay.
    dealt = materialize(near.repartition(parts).withColumn("part", F.spark_partition_id()), "findings-dealt")
    # A count of its own keeps small parts from being put into one task.
    by_part = dealt.repartition(4 * parts, "part").groupBy("part")

    def share(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        part = int(frame["part"].iloc[0])
        rows = made_findings(training.rows, training.seed + part) + labelled(frame.sort_values(["at", "text", "start", "end", "label"]))
        order = np.random.default_rng([training.seed, part]).permutation(len(rows))
        held, used = order[: len(order) // 5], order[len(order) // 5:]
        return np.stack([w for w, _ in rows]), np.array([y for _, y in rows], dtype=float), held, used, part

    def trained(flat: np.ndarray, turn: int, epochs: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            windows, labels, _, used, part = share(frame)
            network, draw = unpacked(flat, training.seed), np.random.default_rng([training.seed, part, turn])
            descend(network, windows, labels, draw.permutation(used), epochs, training.rate, draw)
            return pd.DataFrame({"flat": [packed(network)], "n": [len(used)]})

        return run

    flat, rounds = packed(Network(training.seed)), max(1, min(ROUNDS, training.epochs))
    for turn in range(rounds):
        epochs = training.epochs // rounds + (turn < training.epochs % rounds)
        networks = by_part.applyInPandas(trained(flat, turn, epochs), "flat array<double>, n bigint")
        each = networks.select("n", F.posexplode("flat").alias("i", "x")).groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
        flat = np.array([r["x"] for r in each.orderBy("i").collect()])

    def outputs(frame: pd.DataFrame) -> pd.DataFrame:
        windows, labels, held, *_ = share(frame)
        network = unpacked(flat, training.seed)
        logits = [network.forward(windows[held[i:i + 1024]])[0] for i in range(0, len(held), 1024)]
        return pd.DataFrame({"logit": np.concatenate([*logits, np.zeros(0)]), "label": labels[held].astype(int)})

    held = materialize(by_part.applyInPandas(outputs, "logit double, label int"), "findings-held")
    place = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("logit") / BIN)))
    bins = held.groupBy(place.alias("place"), "label").agg(F.avg("logit").alias("logit"), F.count("*").alias("n")).orderBy("place", "label").collect()
    slope, shift = calibration(*(np.array([float(r[c]) for r in bins]) for c in ("logit", "label", "n")))
    scores = held.where("label = 1").select((F.col("logit") * (-1 if slope < 0 else 1)).alias("x"))
    true = sum(r["n"] for r in bins if r["label"] == 1)
    missed = int(np.floor((1.0 - training.recall) * true))
    least = scores.orderBy("x").limit(missed + 1).agg(F.max("x")).first()[0]
    if least is None:
        return Scanner(unpacked(flat, training.seed), slope, shift, 0.5, None)
    kept = scores.where(F.col("x") >= least).count()
    return Scanner(unpacked(flat, training.seed), slope, shift, float(logistic(abs(slope) * least + shift)), kept / true)


def weak_findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(text, start, end, label)`` from a corpus: assigned and access keys as secrets, mail addresses as none.

    ``text`` is the neighbourhood of the finding, not the document.
    """
    mail = re.compile(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                spans = [(s, e, 1) for s, e, kind in base_spans(text) if kind != "hex"]
                spans += [(m.start(), m.end(), 0) for m in mail.finditer(text)] if "@" in text else []
                for start, end, label in spans:
                    left, right = max(0, start - BEFORE), min(len(text), end + BEHIND)
                    rows.append((text[left:right], start - left, end - left, label))
            yield pd.DataFrame(rows, columns=["text", "start", "end", "label"])

    picked = docs.select(text_or_empty(text_col).alias("text"))
    return picked.mapInPandas(run, "text string, start int, `end` int, label int")


def scan(df: DataFrame, scanner: Scanner, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Every row with ``out array<struct<kind, start, end, score>>`` over its whole text, by start, then kind.

    Offsets count code points, ends are exclusive. Spans of the patterns have score 1. Null and empty texts have none.
    All other columns stay; one of the new name is replaced.
    """
    df = df.drop(out)
    kind = "array<struct<kind: string, start: int, `end`: int, score: double>>"
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {t}" for c, t in df.dtypes), f"`{out}` {kind}"])
    place, shipped = df.columns.index(text_col), df.sparkSession.sparkContext.broadcast(scanner)
    cell = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def make():
        model = shipped.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, windows, owner = [], [], []
            for row, value in enumerate(batch.column(place)):
                text = value.as_py() or ""
                spans = base_spans(text)
                found.append([(s, KINDS.index(k), e, k, 1.0) for s, e, k in spans])
                for start, end in candidates(text, spans):
                    parts = pieces(start, end)
                    owner.append((row, start, end, len(windows)))
                    windows += [window(text, a, b) for a, b in parts]
            scores = np.maximum.reduceat(model.scores(np.stack(windows)), [at for *_, at in owner]) if windows else []
            for (row, start, end, _), score in zip(owner, scores):
                if score >= model.threshold:
                    found[row].append((start, len(KINDS) - 1, end, "model", float(score)))
            cells = [[{"kind": k, "start": s, "end": e, "score": p} for s, _, e, k, p in sorted(spans)] for spans in found]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, cell)], names=[*batch.schema.names, out])

        return step

    return map_rows(df, make, schema)
