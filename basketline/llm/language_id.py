"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the bytes of a word, one forwards and one backwards; at every
byte a softmax over both states gives the probabilities of the languages. The network is trained
in numpy by backpropagation through time. A document's probabilities are the mean over all its
labelled bytes. The state starts afresh at white space, so equal words are labelled alike and a
task labels each word once; a word above MAX_PIECE bytes is read in pieces of that length.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PIECE = 48
KEPT_WORDS = 400_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """What bounds the training of each language; every language is learned."""

    hidden: int = 12
    #: Labelled documents per language, and words taken of each.
    documents: int = 400
    words: int = 48
    epochs: int = 3
    batch: int = 256
    rate: float = 0.01
    seed: int = 17


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def pack(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix (time, piece) and lengths of pieces sorted by falling length."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum(lengths) - lengths
    steps = np.arange(lengths[0] if len(lengths) else 0)
    places = np.minimum(starts[None, :] + steps[:, None], max(len(flat) - 1, 0))
    return flat[places] if len(flat) else np.zeros((0, len(pieces)), np.uint8), lengths


def reverse(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each column reversed within its length."""
    steps = np.arange(len(data))[:, None]
    rows = np.where(steps < lengths, lengths - 1 - steps, 0)
    return np.take_along_axis(data, rows.reshape(rows.shape + (1,) * (data.ndim - 2)), 0)


def layer(model: dict, side: str, data: np.ndarray, alive: np.ndarray, keep: bool = False):
    """States of one direction, (time, piece, hidden); alive: pieces that reach each step."""
    table, inner, width = model["x" + side], model["h" + side], model["h" + side].shape[0]
    states = np.zeros((len(data), data.shape[1], width), np.float32)
    state = np.zeros((data.shape[1], width), np.float32)
    kept = []
    for t, n in enumerate(alive):
        given, carried = table[data[t, :n]], state[:n] @ inner
        gates = _sigmoid(given[:, : 2 * width] + carried[:, : 2 * width])
        update, reset = gates[:, :width], gates[:, width:]
        new = np.tanh(given[:, 2 * width :] + carried[:, 2 * width :] * reset)
        if keep:
            kept.append((state[:n].copy(), update, reset, new, carried[:, 2 * width :]))
        state[:n] = new + update * (state[:n] - new)
        states[t, :n] = state[:n]
    return states, kept


def probabilities(model: dict, pieces: list[bytes]) -> np.ndarray:
    """Summed probabilities of the languages over the bytes of each piece, any order of lengths."""
    order = np.argsort([-len(p) for p in pieces], kind="stable")
    out = np.zeros((len(pieces), len(model["bias"])), np.float32)
    for first in range(0, len(order), 2048):
        part = order[first : first + 2048]
        data, lengths = pack([pieces[i] for i in part])
        alive = (lengths[None, :] > np.arange(len(data))[:, None]).sum(1)
        ahead, _ = layer(model, "f", data, alive)
        back, _ = layer(model, "b", reverse(data, lengths), alive)
        back = reverse(back, lengths)
        width = ahead.shape[2]
        score = ahead @ model["out"][:width] + back @ model["out"][width:] + model["bias"]
        score = np.exp(score - score.max(2, keepdims=True))
        score /= score.sum(2, keepdims=True)
        score *= (np.arange(len(data))[:, None] < lengths)[:, :, None]
        out[part] = score.sum(0)
    return out


def loss_and_gradients(model: dict, pieces: list[bytes], labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy per byte and its gradients; pieces sorted by falling length."""
    data, lengths = pack(pieces)
    mask = np.arange(len(data))[:, None] < lengths
    alive = mask.sum(1)
    ahead, kept_f = layer(model, "f", data, alive, keep=True)
    turned = reverse(data, lengths)
    back, kept_b = layer(model, "b", turned, alive, keep=True)
    both = np.concatenate([ahead, reverse(back, lengths)], 2)
    score = both @ model["out"] + model["bias"]
    score = np.exp(score - score.max(2, keepdims=True))
    score /= score.sum(2, keepdims=True)
    total = mask.sum()
    right = np.take_along_axis(score, np.broadcast_to(labels[None, :, None], (*mask.shape, 1)), 2)[..., 0]
    loss = float(-(np.log(np.maximum(right, 1e-30)) * mask).sum() / total)
    score[:, np.arange(len(labels)), labels] -= 1
    score *= mask[:, :, None] / np.float32(total)
    flat = both.reshape(-1, both.shape[2])
    grads = {"out": flat.T @ score.reshape(-1, score.shape[2]), "bias": score.sum((0, 1))}
    d_both = score @ model["out"].T
    width = ahead.shape[2]
    for side, seen, kept, d_out in (("f", data, kept_f, d_both[:, :, :width]), ("b", turned, kept_b, reverse(d_both[:, :, width:], lengths))):
        inner = model["h" + side]
        d_table, d_inner = np.zeros_like(model["x" + side]), np.zeros_like(inner)
        d_state = np.zeros((data.shape[1], width), np.float32)
        for t in range(len(data) - 1, -1, -1):
            n = alive[t]
            old, update, reset, new, carried = kept[t]
            d = d_state[:n] + d_out[t, :n]
            d_new = d * (1 - update) * (1 - new * new)
            d_update = d * (old - new) * update * (1 - update)
            d_reset = d_new * carried * reset * (1 - reset)
            d_given = np.concatenate([d_update, d_reset, d_new], 1)
            d_carried = np.concatenate([d_update, d_reset, d_new * reset], 1)
            np.add.at(d_table, seen[t, :n], d_given)
            d_inner += old.T @ d_carried
            d_state[:n] = d * update + d_carried @ inner.T
        grads["x" + side], grads["h" + side] = d_table, d_inner
    return loss, grads


def train(words: list[bytes], labels: np.ndarray, classes: int, settings: Settings) -> dict:
    """Fit the network to words with the number of their language, by Adam; seeded, one thread of work."""
    draw = np.random.default_rng(settings.seed)
    h = settings.hidden
    model = {"out": draw.normal(0, 0.3, (2 * h, classes)), "bias": np.zeros(classes)}
    for side in "fb":
        model["x" + side] = draw.normal(0, 0.3, (256, 3 * h))
        model["h" + side] = draw.normal(0, 1 / np.sqrt(h), (h, 3 * h))
    model = {k: v.astype(np.float32) for k, v in model.items()}
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step = 0
    batches = max(1, -(-len(words) // settings.batch))
    for epoch in range(settings.epochs):
        order = draw.permutation(len(words))
        for part in np.array_split(order, batches):
            part = part[np.argsort([-len(words[i]) for i in part], kind="stable")]
            _, grads = loss_and_gradients(model, [words[i] for i in part], labels[part])
            step += 1
            rate = settings.rate * (1 - (step - 1) / (batches * settings.epochs))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model[k] -= (rate * move).astype(np.float32)
    return model


def fit(docs: DataFrame, text: str, lang: str, key: Column, settings: Settings = Settings()) -> tuple[list[str], dict | None]:  # noqa: B008
    """Languages and network learned from the rows with a language, a key and a text with a letter.

    At most settings.documents rows a language are taken, those with the lowest hash of the key,
    and of each at most settings.words words from a place given by the hash. The sample is bounded
    for each language, so the driver trains on it. Without any such row there are no languages and
    no network.
    """
    rows = docs.select(F.col(lang).alias("lang"), key.alias("key"), F.col(text).alias("text"))
    rows = rows.filter("lang IS NOT NULL AND key IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("hash", F.xxhash64("key", F.lit(settings.seed)))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], None
    languages = sorted(counts)
    # Twice the expected share, so that the limit per language is nearly always filled.
    share = {c: min(1.0, 2 * settings.documents / n) for c, n in counts.items()}
    within = F.lit(False)
    for c in languages:
        within = within | ((F.col("lang") == c) & (F.col("hash").bitwiseAND(0x3FFFFFFF) <= int(share[c] * 0x3FFFFFFF)))
    parts = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    start = F.pmod(F.shiftrightunsigned("hash", 33), F.greatest(F.lit(1), F.size("parts") - settings.words + 1)) + 1
    sample = rows.filter(within).withColumn("parts", parts).select("lang", "hash", F.slice("parts", start.cast("int"), settings.words).alias("words"))
    sample = sample.orderBy("hash", "lang", F.to_json("words")).limit(4 * settings.documents * len(languages)).toPandas()
    words, labels = [], []
    for number, c in enumerate(languages):
        for taken in sample.loc[sample["lang"] == c, "words"].head(settings.documents):
            new = [w.encode()[:MAX_PIECE] for w in taken]
            words += new
            labels += [number] * len(new)
    return languages, train(words, np.array(labels), len(languages), settings)


def predict(docs: DataFrame, text: str, languages: list[str], model: dict | None, keep: list[str] = ["doc_id"], long_word: int = MAX_PIECE) -> DataFrame:  # noqa: B006
    """The columns to keep, lang_pred and score (the mean probability of lang_pred over all bytes).

    A null text, or one without a letter, is `und` with score 0, as is every text where no
    language was learned. Repeated rows stay repeated; other columns are not read. Ties go to the
    language that sorts first.
    """
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    names = [f"_{i}" for i in range(len(keep))]
    known_languages = pa.array([*languages, UNKNOWN], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        sums = np.zeros((0, len(languages)), np.float32)
        for batch in batches:
            letters = batch.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(bool)
            best = np.full(batch.num_rows, len(languages))
            score = np.zeros(batch.num_rows)
            if model is not None:
                if len(index) > KEPT_WORDS:
                    index, sums = {}, sums[:0]
                fresh: list[bytes] = []
                ids, sizes = [], np.zeros(batch.num_rows, np.int64)
                for row, value in enumerate(batch.column(len(names))):
                    words = value.as_py().split() if letters[row] else []
                    for w in [w for w in dict.fromkeys(words) if w not in index]:
                        index[w] = len(index)
                        fresh.append(w)
                    ids.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                    sizes[row] = sum(map(len, words))
                pieces, owner = [], []
                for number, w in enumerate(fresh):
                    for at in range(0, len(w), long_word):
                        pieces.append(w[at : at + long_word])
                        owner.append(number)
                new = np.zeros((len(fresh), len(languages)), np.float32)
                if pieces:
                    np.add.at(new, np.array(owner), probabilities(model, pieces))
                sums = np.concatenate([sums, new])
                for row in np.flatnonzero(sizes):
                    pooled = sums[ids[row]].sum(0, dtype=np.float64) / sizes[row]
                    best[row] = pooled.argmax()
                    score[row] = min(1.0, pooled[best[row]])
            arrays = [batch.column(i) for i in range(len(names))]
            predicted = known_languages.take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*arrays, predicted, pa.array(score)], names=[f.name for f in schema])

    given = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).cast("binary").alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    return given.mapInArrow(run, schema)
