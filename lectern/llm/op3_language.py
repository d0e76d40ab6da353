"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on a bounded sample of labelled
documents. Each text is cut into windows of bytes, which the network reads in both directions; it labels every
position of every window with language probabilities, and a document's probability is their mean over all of
its positions. A–Z count as a–z.

Defined results: a text that is null or has no letter is `und` with score 1; ties go to the language that sorts
first; without a labelled row every text with a letter is `und` with score 0; repeated rows each keep a row; a
null doc_id is not held out and teaches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.textkit import column_bytes, row_chunks, small_batches, thinned

#: Units each way, bytes in a window when labelling and when learning, windows at once, documents a language teaches with.
UNITS, WIDTH, LEARN_WIDTH, AT_ONCE, TEACHERS = 8, 128, 40, 2048, 400
#: Languages that are learned, the commonest first: rare or mistyped marks beyond them teach nothing.
LANGUAGES = 128
EXCERPT, STEPS, BATCH, RATE = 400, 260, 256, 0.02
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
UNDETERMINED = "und"


class Network:
    """Weights of both directions; gates are reset, update, candidate, `units` rows each."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.languages, self.units = languages, units
        self.weights = {}
        for way in "fb":
            self.weights[f"{way}E"] = random.normal(0, 0.3, (3 * units, 256))
            self.weights[f"{way}U"] = random.normal(0, 0.3, (3 * units, units))
            self.weights[f"{way}V"] = random.normal(0, 0.3, (len(languages), units))
        self.weights["c"] = np.zeros((len(languages), 1))
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def read(self, codes: np.ndarray, way: str) -> np.ndarray:
        """The states after each byte; codes are (width, windows), states (width, units, windows)."""
        width, n = codes.shape
        u = self.units
        enter, turn = self.weights[f"{way}E"].copy(), self.weights[f"{way}U"].copy()
        enter[: 2 * u] *= 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        turn[: 2 * u] *= 0.5
        states = np.empty((width, u, n), np.float32)
        state = np.zeros((u, n), np.float32)
        seen, kept = np.empty((3 * u, n), np.float32), np.empty((3 * u, n), np.float32)
        for t in range(width) if way == "f" else range(width - 1, -1, -1):
            np.take(enter, codes[t], axis=1, out=seen, mode="clip")
            np.matmul(turn, state, out=kept)
            gates = seen[: 2 * u]
            gates += kept[: 2 * u]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new = kept[2 * u :]
            new *= gates[:u]
            new += seen[2 * u :]
            np.tanh(new, out=new)
            state = np.subtract(state, new, out=states[t])
            state *= gates[u:]
            state += new
        return states

    def label(self, codes: np.ndarray) -> np.ndarray:
        """Language probabilities of every position: (languages, width, windows)."""
        w = self.weights
        logits = np.einsum("lu,tun->ltn", w["fV"], self.read(codes, "f"), optimize=True)
        logits += np.einsum("lu,tun->ltn", w["bV"], self.read(codes, "b"), optimize=True)
        logits += w["c"][:, :, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def gradients(self, codes: np.ndarray, answer: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross entropy over all positions."""
        width, n = codes.shape
        u, w = self.units, self.weights
        states = {way: self.read(codes, way) for way in "fb"}
        error = self.label(codes)
        error[answer, :, np.arange(n)] -= 1
        error /= width * n
        grads = {"c": error.sum(axis=(1, 2))[:, None]}
        for way in "fb":
            order = list(range(width)) if way == "f" else list(range(width - 1, -1, -1))
            enter, turn, value = w[f"{way}E"], w[f"{way}U"], w[f"{way}V"]
            grads[f"{way}V"] = np.einsum("ltn,tun->lu", error, states[way])
            to_enter, to_turn = np.zeros_like(enter), np.zeros_like(turn)
            back = np.zeros((u, n), np.float32)
            for k in range(width - 1, -1, -1):
                t = order[k]
                before = states[way][order[k - 1]] if k else np.zeros((u, n), np.float32)
                seen, kept = enter[:, codes[t]], turn @ before
                reset = 0.5 * (1 + np.tanh(0.5 * (seen[:u] + kept[:u])))
                update = 0.5 * (1 + np.tanh(0.5 * (seen[u : 2 * u] + kept[u : 2 * u])))
                new = np.tanh(seen[2 * u :] + reset * kept[2 * u :])
                back = back + value.T @ error[:, t, :]
                at_new = back * (1 - update) * (1 - new * new)
                at_update = back * (before - new) * update * (1 - update)
                at_reset = at_new * kept[2 * u :] * reset * (1 - reset)
                at_seen = np.concatenate([at_reset, at_update, at_new])
                at_kept = np.concatenate([at_reset, at_update, at_new * reset])
                np.add.at(to_enter.T, codes[t], at_seen.T)
                to_turn += at_kept @ before.T
                back = back * update + turn.T @ at_kept
            grads[f"{way}E"], grads[f"{way}U"] = to_enter, to_turn
        return grads

    def fit(self, windows: np.ndarray, answers: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
        """Adam over random batches of (windows, width) byte codes."""
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            pick = random.integers(0, len(windows), min(BATCH, len(windows)))
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, g in self.gradients(np.ascontiguousarray(windows[pick].T), answers[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                mean, spread = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
                self.weights[k] -= (rate * mean / (np.sqrt(spread) + 1e-8)).astype(np.float32)
        return self

    def probabilities(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per document, the mean over its positions of the languages' probabilities; (documents, languages)."""
        sizes = np.diff(offsets)
        many = -(-sizes // WIDTH)
        doc = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        start = offsets[doc] + nth * WIDTH
        filled = np.minimum(WIDTH, offsets[doc + 1] - start)
        text = np.concatenate([_LOWER[flat], np.full(WIDTH, 32, np.uint8)])
        total = np.zeros((len(sizes), len(self.languages)))
        for a in range(0, len(doc), AT_ONCE):
            here = slice(a, a + AT_ONCE)
            live = np.arange(WIDTH)[:, None] < filled[here]
            codes = np.where(live, text[start[here] + np.arange(WIDTH)[:, None]], 32)
            found = self.label(codes)
            found *= live
            sums = found.sum(axis=1)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(doc[here], sums[k], len(sizes))
        return total / np.maximum(sizes, 1)[:, None]


def held_out(remainder: int, modulus: int) -> F.Column:
    """Whether crc32(doc_id as text) leaves that remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _excerpts(docs: DataFrame, teachers: int, languages: int) -> list[tuple[str, str]]:
    """(language, excerpt) of at most `teachers` rows of each of the `languages` commonest languages, by hash of id
    and text. Rows are thinned within tasks first; a language whose few distinct rows all fell out gives one."""
    spot = F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - EXCERPT, F.lit(1)))
    open_ = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(2, 4) & F.col("text").rlike(r"\p{L}"))
    open_ = open_.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"), F.substring("text", spot.cast("int"), F.lit(EXCERPT)).alias("part"))
    sizes = {r.lang: r.n for r in open_.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return []
    size = F.try_element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("lang"))
    rows = open_.where(F.col("lang").isin(*sizes) & thinned(F.col("h"), teachers, size))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).where(F.col("n") <= teachers)
    got = [(r.lang, r.part) for r in ranked.select("lang", "part").collect()]
    if missing := sorted(set(sizes) - {lang for lang, _ in got}):
        least = open_.where(F.col("lang").isin(*missing)).groupBy("lang").agg(F.min(F.struct("h", "part")).alias("m"))
        got += [(r.lang, r.part) for r in least.select("lang", "m.part").collect()]
    return sorted(got)


def learn(docs: DataFrame, teachers: int = TEACHERS, languages: int = LANGUAGES) -> Network:
    """A network taught by at most `teachers` documents of each of at most `languages` languages, an excerpt of each."""
    got = _excerpts(docs, teachers, languages)
    names = sorted({lang for lang, _ in got})
    network = Network(names)
    if len(names) < 2:
        return network
    random, windows, answers = np.random.default_rng(3), [], []
    for lang, text in got:
        raw = _LOWER[np.frombuffer(text.encode("utf-8"), np.uint8)]
        for _ in range(4):
            at = int(random.integers(0, max(1, len(raw) - LEARN_WIDTH)))
            part = raw[at : at + LEARN_WIDTH]
            windows.append(np.concatenate([part, np.full(LEARN_WIDTH - len(part), 32, np.uint8)]))
            answers.append(names.index(lang))
    return network.fit(np.stack(windows), np.array(answers))


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predictions(network: Network, column: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of every text of a column."""
    flat, offsets = column_bytes(column)
    languages, scores = [], []
    texts = column.to_pylist()
    for a, b in row_chunks(offsets, 1 << 20):
        got = network.probabilities(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if network.languages else None
        for k, text in enumerate(texts[a:b]):
            if not _has_letter(text):
                languages.append(UNDETERMINED)
                scores.append(1.0)
            elif got is None:
                languages.append(UNDETERMINED)
                scores.append(0.0)
            else:
                best = int(np.argmax(got[k]))
                languages.append(network.languages[best])
                scores.append(float(min(1.0, got[k, best])))
    return languages, scores


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred and score of the whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    out = T.StructType([docs.schema["doc_id"]]).add("held_out", "boolean").add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = predictions(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=out.fieldNames())

    return docs.select("doc_id", held_out(2, 4).alias("held_out"), "text").mapInArrow(run, out)


def identified(docs: DataFrame, network: Network, least: float) -> DataFrame:
    """The document rows, all columns, whose language is determined with a score of `least` or more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = predictions(shared.value, batch.column(at))
            yield batch.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(languages, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))
