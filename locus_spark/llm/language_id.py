"""Language ID by segmentation-marginalised unigrams (operator 4).

A language gives every piece of a fixed public vocabulary a probability. The probability
of a word is the sum over all ways to cut it into pieces, each the product of its
pieces; the forward algorithm adds them up. Piece probabilities are fitted per language
by expectation-maximisation (expected piece counts over all segmentations) on the word
counts of a bounded sample of whole labelled documents, and smoothed by the pooled ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus_spark.llm.common import blocks, bound_batches
from locus_spark.plans.materialize import broadcast_if_small

WORD = re.compile(r"[^\W\d_]+")
START = "▁"  # begins a word, as in the vocabulary
UNKNOWN = 1e-9  # probability of a character outside the vocabulary, the same in each language
CACHE = 100_000  # words whose scores a task keeps
CELLS = 1 << 19  # positions times words times languages of forward sums held at once
TINY = 1e-150  # sums below this are scaled up by its inverse
MAX_DOCS = 50_000  # labelled documents in the sample, over all languages
_STEP = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """The lower-case pieces of a public sentencepiece vocabulary, without control and byte pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return sorted({p for p in pieces if p == p.lower() and WORD.fullmatch(p.removeprefix(START) or "a")})


class Pieces:
    """Piece probabilities of some languages, and word scores by the forward algorithm."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.probs = np.vstack([probs, np.full((1, probs.shape[1]), UNKNOWN)])  # the last: unknown character
        # Per length: hashes of all beginnings of pieces, and the piece that ends there or -1.
        self.longest = max(map(len, pieces), default=1)
        begun: list[dict[int, int]] = [{} for _ in range(self.longest)]
        for p, i in self.index.items():
            h = 0
            for n, c in enumerate(p):
                h = (h * int(_STEP) + ord(c) + 1) & ((1 << 64) - 1)
                begun[n][h] = i if n == len(p) - 1 else begun[n].get(h, -1)
        ordered = [sorted(b.items()) for b in begun if b]
        self.prefixes = [(np.array([k for k, _ in o], np.uint64), np.array([i for _, i in o], np.int64)) for o in ordered]
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, probs.shape[1]))

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of all pieces in all words.

        All places of all words grow by one character at a time, as long as what they
        have is the beginning of some piece.
        """
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place, h, out = np.arange(len(text)), np.zeros(len(text), np.uint64), []
        for n, (keys, piece) in enumerate(self.prefixes, 1):
            inside = place + n - begin[place] <= lengths[word[place]]
            place, h = place[inside], h[inside] * _STEP + text[place[inside] + n - 1] + np.uint64(1)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found = np.where(keys[at] == h, piece[at], -2)
            if n == 1:
                lone = place[found < 0]
                out.append((lone, 1, np.full(len(lone), len(self.index))))
            hit = found >= 0
            out.append((place[hit], n, found[hit]))
            place, h = place[found > -2], h[found > -2]
        where = np.concatenate([o[0] for o in out])
        start = where - begin[where]
        end = start + np.concatenate([np.full(len(o[0]), o[1]) for o in out])
        return word[where], start, end, np.concatenate([o[2] for o in out])

    def forward(self, words: list[str], edges: tuple | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Forward sums, positions x words x languages, and the logarithms to add to theirs (None: none).

        Where a sum falls below TINY, it and those that later ones are made of are scaled
        up, so that words of any length keep theirs.
        """
        word, start, end, piece = edges or self.edges(words)
        alpha = np.zeros((max(map(len, words)) + 1, len(words), self.probs.shape[1]))
        alpha[0] = 1
        logs, length = None, np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(end, kind="stable")
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        cuts = np.searchsorted(end, np.arange(1, len(alpha) + 1))
        for i in range(1, len(alpha)):
            s = slice(cuts[i - 1], cuts[i])
            step = alpha[start[s], word[s]] * self.probs[piece[s]]
            for lang in range(step.shape[1]):
                alpha[i, :, lang] = np.bincount(word[s], step[:, lang], len(words))
            logs = self._rescale(alpha, logs, i, i - 1, slice(max(0, i + 1 - self.longest), i + 1), length >= i)
        return alpha, logs

    def _rescale(self, sums: np.ndarray, logs: np.ndarray | None, i: int, last: int, window: slice, inside: np.ndarray) -> np.ndarray | None:
        """Scale what later sums are made of if one at ``i`` is low; all of the window has one scale."""
        low = (sums[i] < TINY) & inside[:, None]
        if logs is not None:
            logs[i] = logs[last]
        if low.any():
            logs = np.zeros_like(sums) if logs is None else logs
            sums[window] *= np.where(low, 1 / TINY, 1.0)
            logs[window] += np.where(low, np.log(TINY), 0.0)
        return logs

    def backward(self, words: list[str], edges: tuple) -> tuple[np.ndarray, np.ndarray | None]:
        """Backward sums as ``forward`` gives the others."""
        word, start, end, piece = edges
        length = np.fromiter(map(len, words), np.int64, len(words))
        beta = np.zeros((length.max() + 1, len(words), self.probs.shape[1]))
        beta[length, np.arange(len(words))] = 1
        logs = None
        order = np.argsort(-start, kind="stable")
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        for i in range(len(beta) - 2, -1, -1):
            s = slice(np.searchsorted(-start, -i, "left"), np.searchsorted(-start, -i, "right"))
            step = beta[end[s], word[s]] * self.probs[piece[s]]
            for lang in range(step.shape[1]):
                beta[i, :, lang] += np.bincount(word[s], step[:, lang], len(words))
            logs = self._rescale(beta, logs, i, i + 1, slice(i, i + self.longest), length > i)
        return beta, logs

    def batches(self, words: list[str]) -> Iterator[list[str]]:
        """The words by length, in parts of bounded sums."""
        ordered, at = sorted(words, key=len), 0
        while at < len(ordered):
            n = max(1, CELLS // ((len(ordered[min(at + 3999, len(ordered) - 1)]) + 1) * self.probs.shape[1]))
            yield ordered[at : at + min(n, 4000)]
            at += min(n, 4000)

    def learn(self, words: list[str]) -> None:
        """Score words that aren't known yet."""
        if len(self.known) > CACHE:
            self.known.clear()
        for part in self.batches(words):
            marked = [START + w for w in part]
            alpha, logs = self.forward(marked)
            ends = [len(w) for w in marked], np.arange(len(part))
            self._keep(part, np.log(alpha[ends]) + (0 if logs is None else logs[ends]))

    def _keep(self, words: list[str], scores: np.ndarray) -> None:
        at = len(self.known)
        while at + len(words) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[at : at + len(words)] = scores
        self.known.update(zip(words, range(at, at + len(words))))

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """Log probability of lists of words, by language."""
        new = set().union(*texts) - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set().union(*texts)
        self.learn(sorted(new))
        get = self.known.__getitem__
        out = np.zeros((len(texts), self.probs.shape[1]))
        for k, words in enumerate(texts):
            if words:
                out[k] = self.table[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
        return out


def fit(counts: list[Counter], pieces: list[str], rounds: int = 2, pooled: float = 500.0) -> Pieces:
    """Piece probabilities per language from its word counts."""
    langs = len(counts)
    start = np.array([0.01 ** (1 / (1 + len(p))) / len(pieces) for p in pieces])
    model = Pieces(pieces, np.repeat(start[:, None], langs, 1))
    vocab = sorted(set().union(*counts))
    lattice = []
    for part in model.batches(vocab):
        marked = [START + w for w in part]
        lattice.append((marked, np.array([[c.get(w, 0) for c in counts] for w in part], float), model.edges(marked)))
    for _ in range(rounds):
        expected = np.zeros((len(pieces) + 1, langs))
        for part, times, edges in lattice:
            word, begin, end, piece = edges
            (alpha, up), (beta, down) = model.forward(part, edges), model.backward(part, edges)
            last = [len(w) for w in part], np.arange(len(part))
            share = alpha[begin, word] * model.probs[piece] * (beta[end, word] * (times / alpha[last])[word])
            if up is not None or down is not None:
                up, down = (np.zeros_like(alpha) if x is None else x for x in (up, down))
                share = share * np.exp(up[begin, word] + down[end, word] - up[last][word])
            for lang in range(langs):
                expected[:, lang] += np.bincount(piece, share[:, lang], len(pieces) + 1)
        expected = expected[:-1]
        base = (expected / np.maximum(expected.sum(0), 1)).mean(1) + 0.1 / len(pieces)
        probs = (expected + pooled * base[:, None]) / (expected.sum(0) + pooled * base.sum())
        model = Pieces(pieces, probs)
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            seen: dict[str, Counter] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
            rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                names=["lang", "word", "n"],
            )


def train(labelled: DataFrame, docs_per_lang: int = 200, max_docs: int = MAX_DOCS, vocabulary_path: str | None = None) -> tuple[list[str], Pieces | None]:
    """Fit on rows (id, text, lang): of each language at most ``docs_per_lang`` whole documents,
    those of the smallest id hashes, and fewer if there are so many languages that they
    would exceed ``max_docs`` together."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    langs = labelled.agg(F.count_distinct("lang")).first()[0]
    if langs > max_docs:
        raise ValueError(f"more than {max_docs} languages")
    each = min(docs_per_lang, max_docs // max(1, langs))
    # A row's rank hangs on its id and text; of repeated rows one is enough.
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "digest")
    ids = labelled.select("id", "lang", F.md5("text").alias("digest")).withColumn("r", F.row_number().over(order)).filter(f"r <= {each}")
    ids = ids.select(F.col("id").alias("i"), F.col("lang").alias("l"), F.col("digest").alias("d")).distinct()
    chosen = labelled.join(broadcast_if_small(ids, 100, langs * each), F.expr("id = i AND lang = l AND md5(text) = d")).dropDuplicates(["id", "lang", "d"])
    words = chosen.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {}
    for row in words.toLocalIterator():  # the words of the sample
        counts.setdefault(row["lang"], Counter())[row["word"]] = row["n"]
    langs = sorted(counts)
    return langs, fit([counts[x] for x in langs], vocabulary(vocabulary_path)) if langs else None


def _predict(langs: list[str], model: Pieces | None, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                words = [WORD.findall((t or "").lower()) for t in part.column(text).to_pylist()]
                if model is None:
                    names, score = ["und"] * len(words), np.zeros(len(words))
                else:
                    logs = model.texts(words)
                    best = logs.argmax(1)
                    score = np.minimum(1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1), 1.0)
                    names = [langs[b] if w else "und" for b, w in zip(best.tolist(), words)]
                    score = np.where([bool(w) for w in words], score, 0.0)
                columns = [part.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return run


def identify(
    docs: DataFrame,
    train_rows: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    keep: tuple[str, ...] = (),
    docs_per_lang: int = 200,
    max_docs: int = MAX_DOCS,
    vocabulary_path: str | None = None,
) -> DataFrame:
    """Predict the language of every whole text, trained on the rows where ``train_rows`` holds.

    Returns id_column, the columns in ``keep``, lang_pred string and score double (the
    posterior of the language under equal priors, 0 to 1). A kept column called
    lang_pred, score or _text is left out unless it is the id or the text.

    Training takes text and non-null language alone; rows with a null id or text aren't
    trained on. A null or empty text, or one without a letter, is ``und`` with score 0;
    so is every text if no language can be learned. Ties go to the first language in
    alphabetical order. Texts are whole at any length; repeated rows are scored each;
    other columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs)
    use = F.lit(True) if train_rows is None else train_rows
    labelled = docs.filter(use).select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    langs, model = train(labelled, docs_per_lang, max_docs, vocabulary_path)
    kept = [c for c in dict.fromkeys([id_column, *keep]) if c not in ("lang_pred", "score", "_text") or c in (id_column, text_column)]
    text = text_column if text_column in kept and docs.schema[text_column].dataType.simpleString() == "string" else "_text"
    wanted = docs.select(*kept) if text == text_column else docs.select(*kept, F.col(text_column).cast("string").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields]
    return wanted.mapInArrow(_predict(langs, model, kept, text), ", ".join([*kinds, "lang_pred string", "score double"]))
