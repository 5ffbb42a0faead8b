"""The language of documents and of their paragraphs.

Nearest-centroid classification: labelled samples (a bounded, documented set) give TF-IDF vectors of hashed character n-grams;
term weights count texts and languages; the vectors of each language are clustered into ``CENTROIDS`` unit centroids (spherical k-means). A paragraph gets the
language of the centroid of highest cosine, none where the best cosine is under ``REJECT``. The model is a small
array that goes out with the tasks; the corpus is read once, map-only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES, CENTROIDS, REJECT = 4096, 2, 0.06
MAX_SAMPLES = 8_192  # labelled rows that a model may be fitted on: 130 MB of vectors on the driver

# Names of the languages in labels; region, script and case don't matter.
CODES = {
    "en": "en", "eng": "en", "english": "en",
    "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "中文": "zh",
    "es": "es", "spa": "es", "spanish": "es", "español": "es",
    "pt": "pt", "por": "pt", "portuguese": "pt", "português": "pt",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
}

_NOT_TEXT = re.compile(r"[\W\d_]+")
_PARAGRAPH_END = re.compile(r"\S[.。!?！？…]+[\"”»」)）]*\s*$")
_HAN = re.compile(r"[㐀-鿿]")


def label(text: str | None) -> str | None:
    """The language that a label names, None where it names none."""
    if not text:
        return None
    t = text.strip().casefold()
    return CODES.get(t) or CODES.get(re.split(r"[-_ ]", t)[0])


def counts(texts: list[str], features: int = FEATURES) -> np.ndarray:
    """Counts of the hashed n-grams (1 to 4 characters, words apart) of each text."""
    clean = [" " + _NOT_TEXT.sub(" ", t.casefold()).strip() + "   " for t in texts]
    n = np.fromiter(map(len, clean), dtype=np.int64, count=len(clean))
    c = np.frombuffer("".join(clean).encode("utf-32-le"), dtype=np.uint32)
    row = np.repeat(np.arange(len(clean), dtype=np.int64), n) * features
    out = np.zeros(len(clean) * features, dtype=np.int32)
    with np.errstate(over="ignore"):
        # Alone, a Chinese character counts as its script: there are too many for the samples to hold.
        one = np.where((c >= 0x3400) & (c <= 0x9FFF), np.uint32(0x4E00), c) * np.uint32(2654435761)
        two = c[:-1] * np.uint32(2654435761) + c[1:] * np.uint32(2246822519)
        three = two[:-1] + c[2:] * np.uint32(3266489917)
        four = three[:-1] + c[3:] * np.uint32(668265263)
        for cut, h in enumerate((one, two, three, four)):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(2146121005)
            index = ((h ^ (h >> np.uint32(13))) % np.uint32(features)).astype(np.int64)
            out += np.bincount(row[: len(row) - cut] + index, minlength=len(out)).astype(np.int32)
    return out.reshape(len(clean), features)


class Model:
    """Centroids of languages over TF-IDF vectors; without labelled texts it rejects all."""

    def __init__(self, labelled: list[tuple[str, str]], centroids: int = CENTROIDS, features: int = FEATURES, rounds: int = 12):
        self.features = features
        self.languages: list[str] = []
        if not labelled:
            return
        texts = [t for _, t in labelled]
        tf = np.concatenate([self._tf(counts(texts[at : at + 256], features)) for at in range(0, len(texts), 256)])
        idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0))) + 1
        # An n-gram that several languages use says little about any: a second factor counts languages instead of texts.
        kinds = sorted({k for k, _ in labelled})
        usual = np.stack([(tf[[i for i, (k, _) in enumerate(labelled) if k == lang]] > 0).mean(axis=0) for lang in kinds])
        used = (usual > 0.15 * usual.max(axis=0)).sum(axis=0).clip(1)
        self.idf = (idf * np.log((len(kinds) + 0.5) / used)).astype(np.float32)
        vectors = self._unit(tf * self.idf)
        rows = []
        for lang in sorted({k for k, _ in labelled}):
            own = vectors[[i for i, (k, _) in enumerate(labelled) if k == lang]]
            k = min(centroids, len(own))
            # Farthest-first start, so that the result doesn't depend on chance.
            chosen = [0]
            while len(chosen) < k:
                chosen.append(int((own @ own[chosen].T).max(axis=1).argmin()))
            centers = own[chosen]
            for _ in range(rounds):
                nearest = (own @ centers.T).argmax(axis=1)
                centers = np.stack([self._unit(own[nearest == j].sum(axis=0, keepdims=True))[0] if (nearest == j).any() else centers[j] for j in range(k)])
            rows.append(centers)
            self.languages += [lang] * k
        self.matrix = np.concatenate(rows).T.astype(np.float32)

    @staticmethod
    def _tf(c: np.ndarray) -> np.ndarray:
        return np.sqrt(c.astype(np.float32))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def classify(self, texts: list[str], reject: float = REJECT) -> list[tuple[str | None, float]]:
        """Language and cosine of each text; None under ``reject`` and for texts without letters."""
        if not self.languages:
            return [(None, 0.0)] * len(texts)
        out: list[tuple[str | None, float]] = []
        for at in range(0, len(texts), 128):
            weighted = self._tf(counts(texts[at : at + 128], self.features)) * self.idf
            norms = np.sqrt(np.einsum("ij,ij->i", weighted, weighted))
            cosine = (weighted @ self.matrix) / np.maximum(norms, 1e-9)[:, None]
            best = cosine.argmax(axis=1)
            for i, b in enumerate(best):
                score = float(cosine[i, b])
                out.append((self.languages[b] if score >= reject else None, score))
        return out


def fit(samples: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """A model of at most ``MAX_SAMPLES`` labelled rows, the same ones whatever the order of the table."""
    rows = samples.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text).orderBy(F.xxhash64(text, lang), text, lang).limit(MAX_SAMPLES).collect()
    return Model(sorted((r[0], r[1]) for r in rows))


def is_paragraph(line: str) -> bool:
    """Whether a line of an article is running text: it ends a sentence, or is too long for anything else."""
    s = line.strip()
    han = len(_HAN.findall(s))
    if han * 3 > len(s):
        return bool(_PARAGRAPH_END.search(s)) and len(s) >= 10 or han >= 45
    return bool(_PARAGRAPH_END.search(s)) and len(s) >= 25 and s.count(" ") >= 3 or len(s) >= 120


def _classifier(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owners, numbers, texts = [], [], []
            for d, (text, title, furniture) in enumerate(zip(batch["text"], batch["title"], batch["furniture"])):
                cut = set(furniture) if furniture is not None else set()
                head = title.strip() if title else None
                for i, line in enumerate(text.split("\n"), 1):
                    if i not in cut and line.strip() != head and is_paragraph(line):
                        owners.append(d)
                        numbers.append(i)
                        texts.append(line)
            found = model.classify(texts)
            by_doc: dict[int, list[tuple[int, str | None, float, int]]] = {}
            for d, i, (lang, score), t in zip(owners, numbers, found, texts):
                by_doc.setdefault(d, []).append((i, lang, score, len(t)))
            out = []
            ids, labels = batch["doc_id"].tolist(), batch["lang"].tolist()
            for d, rows in by_doc.items():
                votes, size = Counter(), Counter()
                for _, lang, _, n in rows:
                    if lang:
                        votes[lang] += 1
                        size[lang] += n
                if not votes:
                    continue
                main = max(votes, key=lambda k: (votes[k], size[k], k))
                share = votes[main] / len(rows)
                out.append((ids[d], 0, main, share, label(labels[d]) == main))
                out += [(ids[d], i, lang, score, False) for i, lang, score, _ in rows if lang and lang != main]
            yield pd.DataFrame(out, columns=["doc_id", "line_no", "lang", "confidence", "label_right"])

    return run


def languages(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, line_no, lang, confidence, label_right``: each document's main language (line 0) and its paragraphs in others.

    ``documents`` has doc_id, text, title, lang and ``furniture``, the lines to leave out (null: none). The main language is
    that of most paragraphs, ties go to more text. Null texts and texts without a paragraph have no row.
    """
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text", "title", "lang", "furniture")
    return rows.mapInPandas(_classifier(model), "doc_id long, line_no int, lang string, confidence double, label_right boolean")


def found(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, line_no, lang``: main languages that the label doesn't give, and paragraphs in another one."""
    return languages(documents, model).where("NOT label_right").select("doc_id", "line_no", "lang")
