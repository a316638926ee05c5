"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language: by features of the word (its prefixes, suffixes and other
n-grams of characters, and the lexicon that it stands in) and by learned transitions between neighbours, so that text
that switches language is labelled run by run. Forward-backward gives each word's posterior; a document's
language is the one with the largest mean posterior, which is its score.

Learning. The labels are those of documents; all words of a training document have its label. Sequences of
``CHUNK`` words are cut out of documents chosen by a hash, about ``per_label`` for each language at most: this is the only sample, and
its size is a parameter. A part of them are joined halves of chunks in two languages, from which transitions
learn what a switch looks like. Weights come from full gradients of the likelihood, on the driver, over the sample alone.

Labelling runs in Arrow batches without any exchange. Words are looked up among those that the worker has met; new ones are
taken apart by array operations. Sequences are cut into blocks of ``BLOCK`` words: the product of a block's
steps is one small matrix, messages pass from block to block, and then all blocks are filled in
at once. This is the exact forward-backward, also for a text of many blocks, and costs the cube of the number of languages for each word.
Memory grows with the longest text, by about 200 bytes a word.

Nulls: a null text, or one without letters, has language ``und`` and score 0. A null id counts as an empty one where rows are divided; a null language teaches nothing.
Without any language to learn all are ``und``; with a single one it is every text's, with score 1. Equal means go to the first language in order.
Repeated rows are labelled alike, and may repeat in the sample. An empty table gives an empty result. Texts are taken whole. All columns of the
input pass through; lang_pred, score, n_words, n_switches and spans replace columns of these names.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARKS = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c)[0] == "M")
#: Letters, and the combining marks on them. Numbers that ``re`` takes for letters make no word (``has_letter``).
WORD = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")
CHUNK, BLOCK = 32, 32
LONGEST = 24
HASHED = 1 << 15
OWN = ("lang_pred", "score", "n_words", "n_switches", "spans")
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def ngram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): for each place in the words, set between marks, the hashed n-grams of 1 to 4 characters that begin there, and
    where each word begins. An n-gram that would leave its word is ``HASHED``. Those that hold a mark are prefixes and suffixes."""
    text = "\x02" + "\x03\x02".join(words) + "\x03"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(code))  # characters up to the word's end
    ids = np.full((4, len(code)), HASHED, np.int64)
    mixed = np.zeros(len(code), np.uint64)
    for n in range(4):
        m = len(code) - n
        if m <= 0:
            break
        mixed[:m] = (mixed[:m] + np.uint64(n + 1)) * _PRIMES[0] ^ code[n:] * _PRIMES[n]
        h = (mixed[:m] * _PRIMES[1]) >> np.uint64(64 - 15)
        ids[n, :m] = np.where(left[:m] > n, h.astype(np.int64), HASHED)
    return ids, starts


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (HASHED + 1, labels): the last row is zero
    lexicon: dict[str, int]  # word to the class of words that it belongs to
    classes: np.ndarray  # (number of classes + 1, labels): the last row is of words in none
    transitions: np.ndarray  # (labels, labels), logarithms

    def emissions(self, words: list[str]) -> np.ndarray:
        ids, starts = ngram_ids(words)
        own = self.weights[ids[0]] + self.weights[ids[1]] + self.weights[ids[2]] + self.weights[ids[3]]
        none = len(self.classes) - 1
        return np.add.reduceat(own, starts, axis=0) + self.classes[[self.lexicon.get(w, none) for w in words]]

    def posteriors(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Posterior of every label for every word; ``emissions`` has the words of texts one after another, ``sizes`` words each (over 0)."""
        n_labels, n = len(self.labels), len(emissions)
        step = np.exp(self.transitions - self.transitions.max())
        local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks  # block of each text's first words
        begins = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(n) - begins[own]
        at, place = first[own] + inside // BLOCK, inside % BLOCK
        total = int(blocks.sum())
        e = np.ones((BLOCK, total, n_labels))
        e[place, at] = local
        there = np.zeros((BLOCK, total), bool)
        there[place, at] = True
        opens = np.zeros(total, bool)
        opens[first] = True

        def normal(x: np.ndarray, axis) -> np.ndarray:
            return x / x.max(axis=axis, keepdims=True)

        def moved(x: np.ndarray, t: int) -> np.ndarray:
            """Messages before word t of each block: a text's first word has no transition."""
            out = (x.reshape(-1, n_labels) @ step).reshape(x.shape)
            if t == 0:
                out[opens] = x[opens]
            return out

        # 1. The product of each block's steps.
        product = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
        for t in range(BLOCK):
            new = normal(moved(product, t) * e[t][:, None, :], (1, 2))
            product = np.where(there[t][:, None, None], new, product)
        # 2. Messages from block to block, over all texts at once.
        ahead, back = np.ones((total, n_labels)), np.ones((total, n_labels))
        order = np.argsort(-blocks, kind="stable")
        count = np.searchsorted(-blocks[order], -np.arange(1, int(blocks.max(initial=0)) + 1), side="right")  # texts with so many blocks
        for k in range(1, len(count)):
            b = first[order[: count[k]]] + k
            ahead[b] = normal(np.einsum("bi,bij->bj", ahead[b - 1], product[b - 1]), 1)
        for k in range(len(count) - 1, 0, -1):
            b = first[order[: count[k]]] + k
            back[b - 1] = normal(np.einsum("bij,bj->bi", product[b], back[b]), 1)
        # 3. Within all blocks at once.
        alpha = np.empty_like(e)
        x = ahead
        for t in range(BLOCK):
            new = normal(moved(x, t) * e[t], 1)
            x = alpha[t] = np.where(there[t][:, None], new, x)
        x, both = back, alpha
        for t in range(BLOCK - 1, -1, -1):
            both[t] *= x
            new = (e[t] * x) @ step.T
            if t == 0:
                break  # the block before has its own message
            x = np.where(there[t][:, None], normal(new, 1), x)
        out = both[place, at]
        return out / out.sum(axis=1, keepdims=True)


def words_of(text: str | None) -> list[str]:
    """Words in small letters; long ones in pieces of LONGEST characters."""
    found = WORD.findall((text or "").lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def has_letter(word: str) -> bool:
    return any(c.isalpha() for c in word)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def training_chunks(docs: DataFrame, may: Column, lang: str, text: str, doc_id: str, per_label: int) -> list[tuple[str, list[str]]]:
    """(language, words) of about ``per_label`` chunks a language at most, in the order of a hash."""
    source = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).cast("string").alias("id"), may.alias("may"))
    source = source.where(F.col("may") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in source.groupBy("lang").count().collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), "text"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, 1.2 * per_label / c))])
    each = {k: max(1, min(8, per_label // c)) for k, c in counts.items()}
    picked = source.withColumn("h", place).where(F.col("h") < F.try_element_at(share, F.col("lang")) * F.lit(float(1 << 30)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, str]] = []
            for kind, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = [x for x in words_of(text) if has_letter(x)]
                for k in range(each[kind]):
                    spot = (h * (2 * k + 1) * 2654435761 >> 7) % max(1, len(w) - CHUNK + 1)
                    if w and (k == 0 or len(w) >= 2 * CHUNK):
                        out.append((kind, (h * (k + 1)) % (1 << 30), " ".join(w[spot : spot + CHUNK])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["lang", "h", "words"])

    chunks = picked.select("lang", "text", "h").mapInArrow(cut, "lang string, h long, words string")
    found = chunks.orderBy("h", "lang", "words").limit(2 * per_label * len(counts)).collect()
    return [(r["lang"], r["words"].split(" ")) for r in found]


def _lexicon(chunks: list[tuple[str, list[str]]], labels: list[str]) -> dict[str, int]:
    """Words met in two chunks or more, by the language that has most of them and how surely: three classes for each language."""
    seen: dict[str, Counter] = {}
    for lang, words in chunks:
        for w in set(words):
            seen.setdefault(w, Counter())[lang] += 1
    size = Counter(lang for lang, _ in chunks)
    out = {}
    for w, c in seen.items():
        if c.total() >= 2:
            rate = {k: n / size[k] for k, n in c.items()}
            top = max(sorted(rate), key=rate.get)
            share = rate[top] / sum(rate.values())
            out[w] = 3 * labels.index(top) + (0 if share < 0.7 else 1 if share < 0.95 or c.total() < 4 else 2)
    return out


def fit(chunks: list[tuple[str, list[str]]], rounds: int = 40, seed: int = 7) -> Crf | None:
    """Weights by full gradients (Adam) of the regularised likelihood of the chunks and of joined halves."""
    labels = sorted({lang for lang, _ in chunks})
    if not labels:
        return None
    n_labels = len(labels)
    lexicon = _lexicon(chunks, labels)
    model = Crf(labels, np.zeros((HASHED + 1, n_labels)), lexicon, np.zeros((3 * n_labels + 1, n_labels)), np.zeros((n_labels, n_labels)))
    if n_labels == 1:
        return model
    random = np.random.default_rng(seed)
    sequences = [([labels.index(lang)] * len(w), w) for lang, w in chunks]
    for (x, a), (y, b) in zip(sequences[0::4], sequences[2::4], strict=False):
        i, j = (int(random.integers(1, len(w) + 1)) for w in (a, b))
        sequences.append((x[:i] + y[:j], a[:i] + b[:j]))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, s in sequences for w in s))}
    known = list(vocabulary)
    ids, starts = ngram_ids(known)
    of = np.repeat(np.arange(len(known)), np.diff([*starts, ids.shape[1]]))
    kind = np.array([lexicon.get(w, 3 * n_labels) for w in known])
    # Padded to the length of the longest: (place, sequence).
    longest = max(len(w) for _, w in sequences)
    word, gold, there = (np.zeros((longest, len(sequences)), t) for t in (np.int64, np.int64, bool))
    for k, (y, w) in enumerate(sequences):
        word[: len(w), k], gold[: len(w), k], there[: len(w), k] = [vocabulary[x] for x in w], y, True
    inner = there[1:]
    n_words = there.sum()
    gold_words = np.zeros((len(known), n_labels))
    np.add.at(gold_words, (word[there], gold[there]), 1)
    gold_pairs = np.zeros((n_labels, n_labels))
    np.add.at(gold_pairs, (gold[:-1][inner], gold[1:][inner]), 1)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.classes, model.transitions)]
    flat, flat_of = ids.ravel(), np.tile(of, 4)
    for r in range(1, rounds + 1):
        own = sum(model.weights[ids[n]] for n in range(4))
        emission = np.add.reduceat(own, starts, axis=0) + model.classes[kind]
        local = np.exp(emission - emission.max(axis=1, keepdims=True))[word]
        step = np.exp(model.transitions - model.transitions.max())
        alpha, beta = np.empty_like(local), np.ones_like(local)
        x = alpha[0] = local[0] / local[0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            new = (x @ step) * local[t]
            x = alpha[t] = np.where(there[t][:, None], new / new.sum(axis=1, keepdims=True), x)
        pairs = np.zeros((n_labels, n_labels))
        for t in range(longest - 1, 0, -1):
            message = local[t] * beta[t]
            both = alpha[t - 1][:, :, None] * step * message[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True))[there[t]].sum(axis=0)
            new = message @ step.T
            beta[t - 1] = np.where(there[t][:, None], new / new.sum(axis=1, keepdims=True), beta[t])
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        slope = gold_words - np.stack([np.bincount(word[there], post[..., k][there], len(known)) for k in range(n_labels)], axis=1)
        by_id = np.stack([np.bincount(flat, slope[flat_of, k], HASHED + 1) for k in range(n_labels)], axis=1)
        by_kind = np.stack([np.bincount(kind, slope[:, k], 3 * n_labels + 1) for k in range(n_labels)], axis=1)
        for p, g, (m, v) in zip((model.weights, model.classes, model.transitions), (by_id, by_kind, gold_pairs - pairs), moments, strict=True):
            g = g / n_words - 1e-6 * p
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p += 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
        model.weights[HASHED] = 0
    return model


class Labeller:
    """Emissions by word, kept by the worker up to a bound."""

    def __init__(self, model: Crf, most: int = 500_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.labels)))

    def emissions(self, texts: list[list[str]]) -> np.ndarray:
        """Emissions of all words, one text after another."""
        if len(self.places) > self.most:
            self.clear()
        places = self.places
        new = list({w for t in texts for w in t if w not in places})
        if new:
            before = len(places)
            if before + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(new)), len(self.model.labels)))])
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                self.rows[before + i : before + i + len(part)] = self.model.emissions(part)
            places.update(zip(new, range(before, before + len(new)), strict=True))
        at = np.fromiter((places[w] for t in texts for w in t), np.int64)
        return self.rows[at]


_labellers: dict[str, Labeller] = {}


def identify(docs: DataFrame, model: Crf | None, text: str = "text", spans: bool = False) -> DataFrame:
    """Adds lang_pred, score, n_words and n_switches (places where neighbours' likeliest languages differ) and, if asked for, spans: the runs of words of one
    language as (lang, begin, end) in characters of the text."""
    out = [c for c in docs.columns if c not in OWN]
    kind = "lang_pred string, score double, n_words long, n_switches long" + ", spans array<struct<lang:string,begin:int,end:int>>" * spans
    if model is None:
        und = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "n_words": F.lit(0).cast("long"), "n_switches": F.lit(0).cast("long")}
        none = {"spans": F.array().cast("array<struct<lang:string,begin:int,end:int>>")} if spans else {}
        return docs.select(*[F.col(f"`{c}`") for c in out], *[v.alias(k) for k, v in (und | none).items()])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded: HASHED weights and the lexicon of the sample
    key = uuid.uuid4().hex  # of this model, in workers that have met others

    def found(texts: list[str | None], labeller: Labeller) -> list[tuple]:
        labels = labeller.model.labels
        words = [[w for w in words_of(t) if w.isalpha() or has_letter(w)] for t in texts]
        full = [i for i, w in enumerate(words) if w]
        rows: list[tuple] = [("und", 0.0, 0, 0, [])] * len(texts)
        if not full:
            return rows
        sizes = np.array([len(words[i]) for i in full])
        post = labeller.model.posteriors(labeller.emissions([words[i] for i in full]), sizes)
        begins = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(post, begins, axis=0) / sizes[:, None]
        best = mean.argmax(axis=1)
        likely = post.argmax(axis=1)
        switch = np.concatenate([[False], likely[1:] != likely[:-1]])
        switch[begins] = False
        switches = np.add.reduceat(switch.astype(np.int64), begins)
        for k, i in enumerate(full):
            own = _runs(texts[i], [labels[x] for x in likely[begins[k] : begins[k] + sizes[k]]]) if spans else []
            rows[i] = (labels[best[k]], min(1.0, float(mean[k, best[k]])), int(sizes[k]), int(switches[k]), own)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labellers.get(key)
        if labeller is None:
            _labellers.clear()
            labeller = _labellers[key] = Labeller(shared.value)
        for batch in batches:
            texts, rows, part, held = batch.column(batch.num_columns - 1), [], [], 0
            for t in texts:
                part.append(t.as_py())
                held += len(part[-1] or "")
                if held > 2_000_000:
                    rows += found(part, labeller)
                    part, held = [], 0
            rows += found(part, labeller)
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))]
            own = [pa.array([r[i] for r in rows], kinds[i]) for i in range(5 if spans else 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*(f"_k{i}" for i in range(batch.num_columns - 1)), *OWN[: len(own)]])

    source = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(out)], F.col(text).alias("_text"))
    kinds = [f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[:-1])]
    labelled = source.mapInArrow(run, ", ".join([*kinds, kind]))
    return labelled.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(out)], *OWN[: 5 if spans else 4])


def _runs(text: str, langs: list[str]) -> list[dict]:
    """Runs of one language; ``langs`` goes by the pieces of words_of."""
    out: list[dict] = []
    k = 0
    for m in WORD.finditer(text.lower() if len(text.lower()) == len(text) else text):
        for i in range(m.start(), m.end(), LONGEST):
            end = min(i + LONGEST, m.end())
            if not has_letter(text[i:end]):
                continue
            lang = langs[min(k, len(langs) - 1)]
            k += 1
            if out and out[-1]["lang"] == lang:
                out[-1]["end"] = end
            else:
                out.append({"lang": lang, "begin": i, "end": end})
    return out


def identify_languages(docs: DataFrame, per_label: int = 1500, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", spans: bool = False) -> DataFrame:
    """Learns from the rows that are not held out and labels all: adds held_out and what ``identify`` adds."""
    model = fit(training_chunks(docs, ~is_held_out(F.col(doc_id)), lang, text, doc_id, per_label))
    return identify(docs, model, text, spans).withColumn("held_out", is_held_out(F.col(doc_id)))
