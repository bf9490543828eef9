"""Toxicity by a weighted lexicon (operator 6).

Texts are folded before matching: characters without width go, compatibility forms
(fullwidth, mathematical) become plain letters, lower case, letters that
look like Latin ones (Cyrillic, Greek, Armenian, small capitals; capitals by the
look of the capital) become these, digits and signs that stand for letters too. An
Aho-Corasick automaton finds all lexicon entries in one pass. An entry is a word
or the beginning of a word family; it counts where a word begins (and, for a
whole word, ends). Matches inside an exception phrase do not count. The weights of
the matches are summed, normalised by the length in words, and put through a
logistic curve.

Entries and weights come from labelled documents: log odds of the documents that
hold a word, or words with a beginning, among toxic and other documents, over a
start list with a common weight. At most `sample` labelled documents are used,
chosen by a hash of their id; the words are counted by tasks, and only entries
that reach `least_docs` and `least_weight` come to the driver.

Defined cases: NULL and empty texts have no match; repeated rows score alike; NULL
ids stay NULL; an empty table gives no rows; without labels of both kinds the
start list and a fixed curve are used; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ToxicityParams:
    """sample: most labelled documents to learn from. family: lengths of word beginnings tried. per: words that the sum is taken over."""

    sample: int = 20000
    least_docs: int = 3
    least_weight: float = 3.0
    family: tuple[int, ...] = (4, 5, 6)
    per: float = 100.0


# start list: insults of general use
SEEDS = ("idiot", "moron", "imbecile", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "idiota", "imbécil", "estúpido", "abruti", "crétin", "dummkopf", "abschaum")
SEED_WEIGHT = 4.0
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash collection", "clown fish", "circus clown", "class clown", "sore loser", "no idiot", "not stupid", "not worthless")

# letters that look like Latin ones: Cyrillic, Greek, Armenian, small capitals and phonetic letters
LOOKALIKES = dict(
    zip(
        "абвгдеёзийіїјклмнорстухѕԁһԛԝαβγεηικνορτυχωϲ" "зѐєҽмпшщьъүұӏґғԍѵѡҝӓӧ" "μπσςϳ" "օոսհցզյա" "ɑɡıɩȷʋᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ",
        "a6brдeeзииiijkлмhopctyxsdhqwabyenikvoptuxwc" "3eeemnwwbbyylrfgvwkao" "unooj" "onuhgqjw" "agiijvabcdefghijklmnoprstuvwyz",
        strict=True,
    )
)
# capitals that look like another letter than their small letter does; they go before lower case
CAPITALS = dict(zip("ΗΝΥΜΖΣΓΠΧΙİՏՍԼՕ", "hnymzerпxiisulo", strict=True))
# l, 1, ! and | stand for each other and for i, so all fold to i
SIGNS = str.maketrans("0134578@$!|+l", "oieastbasiiti")
# characters without width: soft hyphen, joiners, direction and variation marks, tags
UNSEEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
_WORDS = re.compile(r"[^\W_]+")


class _Folds(dict):
    """What each character folds to, worked out when it is first met."""

    def __missing__(self, code: int) -> str:
        c = _single(chr(code), partial(unicodedata.normalize, "NFKC"))
        c = _single(CAPITALS.get(c, c), str.lower)
        self[code] = LOOKALIKES.get(c, c).translate(SIGNS)
        return self[code]


def _single(c: str, change: Callable[[str], str]) -> str:
    """The changed character, or the same if it would become several."""
    changed = change(c)
    return changed if len(changed) == 1 else c


_FOLDS = _Folds()


def visible(text: str) -> str:
    """The text without characters that have no width."""
    return text if text.isascii() else UNSEEN.sub("", text)


def fold(text: str) -> str:
    """The text in the alphabet of the lexicon, character for character (what would change the length is left as it is)."""
    return text.lower().translate(SIGNS) if text.isascii() else text.translate(_FOLDS)


@dataclass
class Lexicon:
    """weights: entry to weight; an entry that ends in * is the beginning of a family. The score is 1 / (1 + exp(-(curve[0] + curve[1] * log1p(density))))."""

    weights: dict[str, float]
    curve: tuple[float, float]
    per: float


def automaton(lexicon: Lexicon):
    import ahocorasick

    found: dict[str, list] = {}
    for entry, weight in lexicon.weights.items():
        found.setdefault(fold(entry.rstrip("*")), []).append((entry.endswith("*"), weight))
    machine = ahocorasick.Automaton()
    for key, kinds in found.items():
        machine.add_word(key, (len(key), False, max(w for _, w in kinds), any(star for star, _ in kinds)))
    for phrase in EXCEPTIONS:
        machine.add_word(fold(phrase), (len(phrase), True, 0.0, False))
    machine.make_automaton()
    return machine


def density(text: str, machine, per: float) -> tuple[float, int]:
    """Weight of the matches per `per` words, and their number."""
    hits, excused = [], []
    text = visible(text)
    folded = fold(text)
    size = len(text)
    for end, (length, exception, weight, family) in machine.iter(folded):
        start = end - length + 1
        if start and text[start - 1].isalnum():
            continue
        if not (family or end + 1 == size or not text[end + 1].isalnum()):
            continue
        if exception:
            excused.append((start, end))
        else:
            hits.append((start, end, weight))
    if not hits:
        return 0.0, 0
    best: dict[int, float] = {}  # one match for each word: the heaviest
    excused.sort()
    at, reach = 0, -1  # phrases that begin up to here, and how far they go
    for start, end, weight in sorted(hits):
        while at < len(excused) and excused[at][0] <= start:
            reach = max(reach, excused[at][1])
            at += 1
        if end > reach:
            best[start] = max(weight, best.get(start, 0.0))
    words = text.count(" ") + text.count("\n") + 1
    return sum(best.values()) * per / max(words, per / 4), len(best)


def scored(x: float, lexicon: Lexicon) -> float:
    a, b = lexicon.curve
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * math.log1p(x)))))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, matches, density) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon)
        for batch in batches:
            found = [density(t, machine, lexicon.per) if (t := x.as_py()) else (0.0, 0) for x in batch.column("text")]
            columns = [
                batch.column("doc_id"),
                pa.array([scored(x, lexicon) for x, _ in found], pa.float64()),
                pa.array([n for _, n in found], pa.int64()),
                pa.array([x for x, _ in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "matches", "density"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, matches long, density double")


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of one variable, with a small ridge, by Newton steps."""
    if not len(y) or y.min() == y.max():
        return -3.0, 2.0
    z = np.stack([np.ones(len(x)), np.log1p(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.diag([1e-3, 1e-2])
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge, z.T @ (y - q) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def learn_lexicon(docs: DataFrame, labels: DataFrame, p: ToxicityParams | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learn entries and curve from the labelled rows given (leave held-out rows out beforehand), at most p.sample of them."""
    p = p or ToxicityParams()
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))  # labels that differ: toxic if one says so
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # at most p.sample rows of two numbers
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    family = p.family

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                text = visible(text or "")
                folded = fold(text)
                words = {folded[m.start() : m.end()] for m in _WORDS.finditer(text)}
                keys = words | {w[:k] + "*" for k in family for w in words if len(w) > k}
                if keys:
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(list(keys)), pa.array([label] * n, pa.int32())], ["entry", "label"])

    counts = rows.groupBy("label").agg(F.count("*").alias("n")).collect()
    n = {r.label: r.n for r in counts}
    toxic, other = n.get(1, 0), n.get(0, 0)
    weights = {s: SEED_WEIGHT for s in SEEDS}
    if toxic and other:
        seen = rows.mapInArrow(entries, "entry string, label int").groupBy("entry").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
        # one more document without toxicity than was seen: a word of few documents weighs less
        odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 1.5) / (other + 1.0))
        # the sample is bounded, and so is what it can teach
        kept = seen.where(F.col("t") >= p.least_docs).withColumn("weight", odds).where(F.col("weight") >= p.least_weight)
        learnt = {r.entry: r.weight for r in kept.select("entry", "weight").collect()}
        # a beginning is needed only where it says more than the words under it
        weights.update({k: w for k, w in learnt.items() if not (k.endswith("*") and any(o != k and not o.endswith("*") and o.startswith(k[:-1]) and learnt[o] >= w for o in learnt))})
    lexicon = Lexicon(weights, (-3.0, 2.0), p.per)
    if toxic and other:
        found = score_toxicity(rows, lexicon).select("doc_id", "density").join(F.broadcast(chosen), "doc_id").select("density", "label").collect()
        lexicon.curve = _curve(np.array([r.density for r in found]), np.array([float(r.label) for r in found]))
    return lexicon
