"""Texts cut off by field limits or broken transfers, and how often each source truncates.

No labels exist, so positives are made: intact texts of the corpus are cut, at their source's field limit or anywhere,
and sometimes given a cut mark; cuts that happen to end a sentence are not used. A logistic regression over hashed features
of the text's end (closing characters, punctuation, open brackets and code blocks, the last words, what they usually lead
to, the shape of the last line, length relative to the limit) learns to tell them from the texts as they are. Texts that a
fit finds cut which has not seen them leave the negatives and it is fitted again. Every text is then scored; the share of
cut texts, which differs from that in training, is estimated from the scores of all of them and moves the threshold.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage, partitions
from .counting import summed_cells

BITS, FOLDS = 18, 3
VOCAB_BITS = 20
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Marks that are put where a text was cut.
MARK = re.compile(r"\s*(?:…|\.\.\.|\[(?:…|\.\.\.|truncated|cut|snip|more)\]|\((?:…|\.\.\.|truncated|more|continued)\)|<truncated>|�+)\s*$", re.I)
MARKS = ("…", " …", "...", " ...", " [truncated]", " (more)", " [...]", "�")
#: What ends a sentence, and what may close after it.
TERMINAL = ".!?。！？"
CLOSERS = "\"'”’»)]}*_`"
_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)]|\[[ xX]\])\s")
_KIND = (
    ("fence", re.compile(r"\s*(?:```|~~~)")),
    ("table", re.compile(r"\s*\|")),
    ("heading", re.compile(r"\s*#{1,6}\s")),
    ("item", _ITEM),
    ("quote", re.compile(r"\s*>")),
    ("field", re.compile(r"\s*[A-Za-z_][\w .-]{0,30}:\s")),
    ("trailer", re.compile(r"\s*(?:See |Refs?|Fixes|Closes|https?://)")),
    ("indent", re.compile(r"(?:\t| {2,})\S")),
)


_hashes: dict[str, int] = {}


def _h(s: str) -> int:
    """The cell of a feature. Most features come again and again, so hashes are remembered, up to a number."""
    h = _hashes.get(s)
    if h is None:
        if len(_hashes) > 300_000:
            _hashes.clear()
        h = _hashes[s] = zlib.crc32(s.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    return h


def word_cell(w: str) -> int:
    return zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) & ((1 << VOCAB_BITS) - 1)


def _cat(c: str) -> str:
    if not c:
        return "none"
    if c in TERMINAL or c in CLOSERS or c in ",;:-|/(<[{":
        return c
    k = unicodedata.category(c)
    if k == "Lo":
        return "ideo"
    return k


def _bucket(n: int) -> str:
    return str(n) if n < 4 else str(int(np.log2(n) * 2))


def features(text: str, source: str | None, limits: list[int], counts: np.ndarray, n_chars: int | None = None, n_bytes: int | None = None) -> list[int]:
    """Hashed features of one text. ``n_chars``/``n_bytes`` stand in for its length, so that training can vary them."""
    src = source or ""
    whole = text.rstrip()
    m = MARK.search(whole)
    mark = m.group().strip().lower() if m else ""
    body = whole[: m.start()].rstrip() if m else whole
    if mark == "..." and body[-1:] in TERMINAL:
        mark = ""
    cut_space = bool(m) and m.group()[:1].isspace()
    n = len(text) if n_chars is None else n_chars
    nb = len(text.encode("utf-8", "surrogatepass")) if n_bytes is None else n_bytes
    at = "far"
    for limit in limits:
        if n == limit or nb == limit:
            at = "at"
        elif at == "far" and (0 < n - limit <= 16 or 0 < limit - nb <= 3 or 0 < nb - limit <= 16):
            at = "near"
    lines = body.split("\n")
    last = lines[-1]
    kind = "plain"
    for name, pattern in _KIND:
        if pattern.match(last):
            kind = name
            break
    fences = sum(1 for x in lines if x.lstrip().startswith(("```", "~~~")))
    open_fence = fences % 2 == 1
    end = body[-1:]
    tail = end
    i = len(body) - 1
    while i >= 0 and body[i] in CLOSERS:
        i -= 1
    before = body[i] if i >= 0 else ""
    closed = end in TERMINAL or (end in CLOSERS and before in TERMINAL)
    tail = _cat(end)
    words = WORD.findall(" ".join(last.rsplit(None, 4)[-4:]))
    w1, w2, w3 = (words[-k] if len(words) >= k else "" for k in (1, 2, 3))
    ends_in_word = bool(w1) and last.endswith(w1)
    common = int(counts[word_cell(w1)]) if w1 else 0
    freq = str(min(6, int(np.log2(common + 1)))) if w1 else "none"
    # the sentence under way
    cut = max((body.rfind(t) for t in (". ", "! ", "? ", ".\n", "!\n", "?\n", "。", "！", "？", "\n\n")), default=-1)
    sentence = body[cut + 1 :].strip()
    n_words = len(WORD.findall(sentence))
    ticks, quotes = last.count("`") % 2, last.count('"') % 2
    depth = sum(sentence.count(a) - sentence.count(b) for a, b in ("()", "[]", "{}", "「」", "（）"))
    single = len(lines) == 1
    first = kind + ("1" if single else "")
    out = [
        "bias", f"src {src}", f"mark {bool(mark)} {cut_space}", f"mark {mark}", f"mark {bool(mark)} {closed}", f"mark {bool(mark)} {src}", f"tail {tail}", f"tail {tail} {kind}", f"closed {closed} {src}", f"closed {closed} {kind} {open_fence}", f"fence {open_fence}", f"fence {open_fence} {kind} {tail}",
        f"at {at} {closed}", f"at {at}", f"at {at} {closed} {src}", f"at {at} {closed} {kind}", f"at {at} {ends_in_word} {closed}", f"kind {kind} {src}", f"single {single} {closed} {src}", f"tick {ticks} {closed}", f"quote {quotes}", f"depth {min(3, max(-1, depth))} {closed}",
        f"n {_bucket(n_words)} {closed}", f"n {_bucket(n_words)} {first} {src} {closed}", f"prev {_cat(before)} {tail}", f"len {_bucket(len(text) // 20)} {src} {closed}",
    ]
    if not closed:
        state = f"{kind} {ends_in_word}"
        out += [
            f"w1 {w1.lower()} {ends_in_word}", f"w1 {w1.lower()} {kind}", f"w2 {w2.lower()} {kind} {ends_in_word}", f"w12 {w2.lower()} {freq}", f"w21 {w2.lower()} {w1.lower()}", f"w32 {w3.lower()} {w2.lower()} {state}", f"w31 {w3.lower()} {w1.lower()}", f"w321 {w3.lower()} {w2.lower()} {w1.lower()}", f"freq {freq} {state}", f"freq {freq} {src} {state}", f"suf1 {w1[-1:]} {freq} {ends_in_word}", f"suf2 {w1[-2:].lower()} {ends_in_word}",
            f"suf3 {w1[-3:].lower()} {kind}", f"wl {min(len(w1), 12)} {freq} {state}", f"cap {w1[:1].isupper()} {state}", f"open {ticks} {quotes} {depth > 0} {kind}",
            f"head {' '.join(last.split()[:2])[:24].lower()} {kind}", f"lines {min(len(lines), 6)} {src} {kind}", f"empty {not last.strip()}", f"end {body[-2:]}", f"end3 {body[-3:]} {kind}",
            f"shape {re.sub(r'[a-z]+', 'a', re.sub(r'[A-Z]+', 'A', re.sub(r'[0-9]+', '0', last[-24:])))[-6:]} {kind}",
        ]
    return [_h(x) for x in out]


def make_cut(text: str, limits: list[int], rng: np.random.Generator) -> tuple[str, int] | None:
    """A cut version of an intact text and the length it would have had, or None if it cannot be cut inside a sentence."""
    whole = text.rstrip()
    fitting = [x for x in limits if 40 <= x < len(whole)]
    for _ in range(4):
        if fitting and rng.random() < 0.5:
            at = int(fitting[int(rng.integers(len(fitting)))])
        elif len(whole) >= 24:
            at = int(rng.integers(max(8, len(whole) // 8), len(whole) - 1))
        else:
            return None
        piece = whole[:at]
        if piece and (piece.rstrip()[-1:] not in TERMINAL + "`|)") and not piece.endswith("\n") and whole[at : at + 1] != "\n" and piece.strip():
            if rng.random() < 0.25:
                return piece.rstrip() + MARKS[int(rng.integers(len(MARKS)))], at
            return piece, at
    return None


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """For each batch the cells of the words of its texts, each text counting once; the last word may be a cut one."""
    known: dict[str, int] = {}
    for b in batches:
        found: list[int] = []
        for t in b.column(0).to_pylist():
            cells = set()
            for w in set(WORD.findall(t)[:-1]):
                c = known.get(w)
                if c is None:
                    if len(known) > 300_000:
                        known.clear()
                    c = known[w] = word_cell(w)
                cells.add(c)
            found += cells
        yield np.array(found, dtype=np.int64)


def field_limits(docs: DataFrame, text: str, source: str, least: int = 5, ratio: float = 8.0) -> list[tuple[str | None, int]]:
    """(source, limit): lengths in characters or bytes that far more different texts of a source have than there are of the
    lengths around, and than chance makes. A limit is a spike: of the lengths up to 4 beside it two at most have a third of
    its texts, which tells it from a usual length."""
    t = F.rtrim(F.col(text))
    sizes = docs.select(source, F.array_distinct(F.array(F.length(t), F.octet_length(t))).alias("ns"), F.xxhash64(t).alias("h")).distinct()
    sizes = sizes.select(source, F.explode("ns").alias("n")).groupBy(source, "n").agg(F.count(F.lit(1)).alias("k")).where("n > 0")
    order = W.partitionBy(source).orderBy("n")
    near = (F.sum("k").over(order.rangeBetween(-20, 20)) - F.col("k")) / 40.0
    beside = F.collect_list("k").over(order.rangeBetween(-4, 4))
    rows = sizes.withColumn("near", near).withColumn("high", F.size(F.filter(beside, lambda x: x * 3 > F.col("k"))))
    usual = F.greatest("near", F.lit(0.25))
    peaks = rows.where((F.col("k") >= least) & (F.col("k") >= ratio * usual) & (F.col("k") >= F.col("near") + 3 * F.sqrt(usual)) & (F.col("high") <= 3))
    return [(r[0], r[1]) for r in peaks.select(source, "n").orderBy(source, "n").collect()]


def _examples(shared, seed: int):
    """Feature rows of sampled texts as they are (label 0) and cut (label 1); ``h`` tells the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, counts = shared.value
        for b in batches:
            rows, labels, ids = [], [], []
            for h, t, s in zip(*(b.column(k).to_pylist() for k in range(3))):
                rng = np.random.default_rng([seed, h & 0x7FFFFFFFFFFFFFFF])
                mine = limits.get(s, [])
                # an intact text may have just the limit's length
                n = int(mine[int(rng.integers(len(mine)))]) if mine and rng.random() < 0.08 else len(t)
                real = len(t) in mine or len(t.encode("utf-8", "surrogatepass")) in mine
                rows.append(features(t, s, mine, counts, n, n) if not real else features(t, s, mine, counts))
                labels.append(0)
                ids.append(h)
                for _ in range(2):
                    c = make_cut(t, mine, rng)
                    if c:
                        rows.append(features(c[0], s, mine, counts))
                        labels.append(1)
                        ids.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.int32()))], names=["h", "label", "x"])

    return run


class Rows:
    """Lists of feature cells, one after the other."""

    def __init__(self, offsets: np.ndarray, cells: np.ndarray):
        self.starts, self.sizes, self.cells = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64), cells.astype(np.int64)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of ``rows`` and how many each has."""
        n = self.sizes[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.cells[at], n

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.cells], self.starts)


def fit_logistic(rows: Rows, which: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.15, l2: float = 1e-5, seed: int = 3, batch: int = 128) -> np.ndarray:
    """Weights by minibatch AdaGrad over the rows ``which``; classes count alike."""
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    y = labels[which]
    share = np.zeros(len(labels))
    share[which] = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    order = which.copy()
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            cells, n = rows.take(part)
            z = np.add.reduceat(w[cells], np.cumsum(n) - n)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * share[part]
            at, inv = np.unique(cells, return_inverse=True)
            grad = np.bincount(inv, np.repeat(err, n)) / len(part) + l2 * w[at]
            g2[at] += grad * grad
            w[at] -= rate * grad / np.sqrt(g2[at])
    return w


def prior_shift(scores: np.ndarray, weights: np.ndarray | None = None, rounds: int = 50) -> float:
    """The logit of the share of cut texts among ``scores`` (logits of a classifier trained on even classes), each of which
    stands for ``weights`` texts."""
    p = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    share = 0.1
    for _ in range(rounds):
        q = share * p / (share * p + (1 - share) * (1 - p))
        share = float(np.clip(np.average(q, weights=weights), 1e-4, 0.5))
    return float(np.log(share / (1 - share)))


def train(docs: DataFrame, key: str, text: str, source: str, sample_rows: int = 20_000, seed: int = 11):
    """(weights of each fold, limits by source, word counts). The fit uses ``sample_rows`` different texts at most, chosen by hash; limits
    and word counts come from all rows."""
    spark = docs.sparkSession
    limits: dict[str | None, list[int]] = {}
    for s, n in field_limits(docs, text, source):
        limits.setdefault(s, []).append(n)
    counts = summed_cells(docs.select(text), _vocabulary, VOCAB_BITS)
    shared = spark.sparkContext.broadcast((limits, counts))
    n = docs.count()
    rows = docs.select(F.xxhash64(key, text).alias("g"), F.xxhash64(text).alias("h"), text, source)
    # hash thresholding keeps the sample bounded without sorting texts; the margin is four standard deviations
    share = 1.0 if n <= sample_rows else (sample_rows - 4 * sample_rows**0.5) / n
    picked = rows.where(F.pmod(F.col("g"), F.lit(1 << 30)) < int(share * (1 << 30))).drop("g").repartition(partitions(spark), "h").dropDuplicates(["h"])
    got = picked.mapInArrow(_examples(shared, seed), "h long, label int, x array<int>").toArrow()
    labels = got.column(1).to_numpy()
    if not got.num_rows or labels.sum() == 0 or labels.sum() == len(labels):
        return np.zeros((FOLDS, 1 << BITS)), shared
    flat = got.column(2).combine_chunks()
    # rows come in no stated order; a fit goes through them in that of their hash
    order = np.lexsort((np.arange(len(labels)), got.column(0).to_numpy()))
    cells, sizes = Rows(flat.offsets.to_numpy(), flat.flatten().to_numpy()).take(order)
    return fit_clean(Rows(np.r_[0, np.cumsum(sizes)], cells), labels[order], got.column(0).to_numpy()[order]), shared


#: What makes a text a suspect: its length is at a limit or just past it and nothing closes it, it has a cut mark, or a
#: block of code is open.
SUSPECT = ("at at False", "at near False", "mark True True", "mark True False", "fence True")


def fit_clean(rows: Rows, labels: np.ndarray, texts: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Weights (``FOLDS`` x cells), those at ``f`` fitted without the texts of fold ``f``, so that every text can be scored by
    a fit that has not seen it. After each round the texts that such a fit finds cut are no longer used as intact ones; in
    the first round suspects are not."""
    marks = np.isin(rows.cells, [_h(x) for x in SUSPECT])
    use = (labels == 1) | (np.add.reduceat(marks.astype(np.int64), rows.starts) == 0)
    fold = texts % FOLDS
    fits = np.zeros((FOLDS, 1 << BITS))
    for _ in range(rounds):
        z = np.zeros(len(labels))
        for f in range(FOLDS):
            fits[f] = fit_logistic(rows, np.flatnonzero(use & (fold != f)), labels)
            z[fold == f] = rows.scores(fits[f])[fold == f]
        use = (labels == 1) | (z + prior_shift(z[labels == 0]) < 0)
    return fits


def truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", least: float = 0.15, **options) -> DataFrame:
    """``(key, source, score, cut)`` for every row with a text: ``score`` is the probability that it was cut off
    and ``cut`` whether that is ``least`` or more (well under a half, as a missed cut costs more than a text looked at in vain).

    Null texts are left out; an empty or blank text is never cut. Rows that repeat a key come out as often as they came in.
    Null sources are one source. With no texts at all the result is empty.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(text).isNotNull()).select(key, text, source)
    weights, shared = train(docs, key, text, source, **options)
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, counts = shared.value
        w = sent.value
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))
            z = [w[f][features(t, s, limits.get(s, []), counts)].sum() if t.strip() else None for t, s, f in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(z, pa.float64())], names=["k", "s", "z"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    scored = cut_lineage(docs.withColumn("__fold", F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")).mapInArrow(run, f"k {kinds[key]}, s {kinds[source]}, z double"))
    # the share of cut texts among all of them, from a histogram of their scores
    bins = scored.where("z IS NOT NULL").groupBy(F.round(F.greatest(F.least("z", F.lit(30.0)), F.lit(-30.0)), 1).alias("z")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    shift = prior_shift(bins.column(0).to_numpy(), bins.column(1).to_numpy()) if bins.num_rows else 0.0
    p = F.coalesce(1 / (1 + F.exp(-(F.col("z") + shift))), F.lit(0.0))
    out = scored.select("k", "s", p.alias("score")).withColumn("cut", F.col("score") >= least)
    return out.withColumnsRenamed({"k": key, "s": source})


def truncation_rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """``texts``, ``cut`` and ``rate`` of each source."""
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("cut").cast("int")).alias("cut")).withColumn("rate", F.round(F.col("cut") / F.col("texts"), 6))
