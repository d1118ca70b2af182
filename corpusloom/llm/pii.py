"""Personal data in free text: a linear-chain CRF over word shapes, trained from a small labelled table, decoded by Viterbi in numpy batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.pii_labels import GIVEN, labelled_sentences

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Training steps, and the least count of a word in the labelled table that makes it a lexical feature.
STEPS, LEXICAL = 90, 12
#: Neighbours whose shapes are features of a token.
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)

_TOKEN = re.compile(r"[(\[](?:at|dot|AT|DOT)[)\]]|\d+|[^\W\d_]+(?:['’][^\W\d_]+)?|[^\w\s]|_")
_SPLIT = re.compile(r"\n+|(?<=[a-zß-ÿ0-9”\")\]][.!?])\s+(?=[A-ZÀ-Þ¿¡“\"])")
_GIVEN = frozenset(GIVEN)
#: Mark of a token that nothing separates from the one before.
GLUE = "\x02"


def _shape(tok: str, lexical: frozenset[str]) -> str:
    if tok.isdigit():
        return f"9{min(len(tok), 10)}"
    low = tok.lower()
    if not tok[0].isalpha():
        return low
    case = "x" if tok.islower() else "X" if tok.isupper() else "Xx" if tok[1:].islower() else "xX"
    if low in lexical:
        return f"={low}/{case}"
    if low in _GIVEN:
        return f"G/{case}"
    return f"{case}{min(len(tok), 4) if case != 'Xx' else (2 if len(tok) < 4 else 6)}"


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token with GLUE in front where nothing separates it from the token before)."""
    out, last = [], -1
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        t = text[s:e]
        out.append((s, e, GLUE + t if s == last else t))
        last = e
    return out


class Tagger:
    """The trained model: emission weights by shape and offset, transition and start weights."""

    def __init__(self) -> None:
        table = labelled_sentences()
        words = Counter()
        for text, spans in table:
            inside = [(s, e) for s, e, k in spans if k in ("person_name", "email")]
            for s, e, t in tokens(text):
                w = t.lstrip(GLUE)
                if w[0].isalpha() and not any(a <= s < b for a, b in inside):
                    words[w.lower()] += 1
        self.lexical = frozenset(w for w, n in words.items() if n >= LEXICAL and w not in _GIVEN)
        self.index: dict[str, int] = {}
        self.cache: dict[str, int] = {}
        seqs, labels = [], []
        for text, spans in table:
            tok = tokens(text)
            y = np.zeros(len(tok), np.int64)
            for s, e, k in spans:
                first = True
                for i, (a, b, _) in enumerate(tok):
                    if s <= a and b <= e:
                        y[i] = 1 + 2 * KINDS.index(k) + (not first)
                        first = False
            seqs.append(np.array([self._grow(t) for _, _, t in tok], np.int64))
            labels.append(y)
        self.pad = len(self.index)
        self.unknown = len(self.index) + 1
        self._train(seqs, labels)

    def _key(self, t: str) -> str:
        return GLUE + _shape(t[1:], self.lexical) if t[0] == GLUE else _shape(t, self.lexical)

    def _grow(self, t: str) -> int:
        return self.index.setdefault(self._key(t), len(self.index))

    def id(self, t: str) -> int:
        i = self.cache.get(t)
        if i is None:
            k = self._key(t)
            i = self.index.get(k)
            if i is None:
                i = self.index.get(k.lstrip(GLUE), self.unknown)
            if len(self.cache) < 400_000:
                self.cache[t] = i
        return i

    def _windows(self, ids: np.ndarray) -> np.ndarray:
        """Shape ids of each place and its neighbours; ids: (sentences, places), padded."""
        wide = np.full((ids.shape[0], ids.shape[1] + 6), self.pad, np.int64)
        wide[:, 3:-3] = ids
        return np.stack([wide[:, 3 + o : 3 + o + ids.shape[1]] for o in OFFSETS], axis=-1)

    def _train(self, seqs: list[np.ndarray], labels: list[np.ndarray]) -> None:
        n, k, v = len(seqs), len(LABELS), len(self.index) + 2
        t_max = max(map(len, seqs))
        ids = np.full((n, t_max), self.pad, np.int64)
        y = np.zeros((n, t_max), np.int64)
        for i, (s, l) in enumerate(zip(seqs, labels)):
            ids[i, : len(s)], y[i, : len(s)] = s, l
        mask = ids != self.pad
        win = self._windows(ids)
        rng = np.random.default_rng(5)
        self.emit = np.zeros((len(OFFSETS), v, k), np.float32)
        self.trans = np.zeros((k, k), np.float32)
        self.start = np.zeros(k, np.float32)
        legal = np.ones((k, k), np.bool_)
        for j in range(2, k, 2):
            legal[:, j] = False
            legal[j - 1, j] = legal[j, j] = True
        self.block = np.where(legal, 0, -30).astype(np.float32)
        params = [self.emit, self.trans, self.start]
        mom = [np.zeros_like(p) for p in params]
        vel = [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(STEPS // 10):
            order = rng.permutation(n)
            for part in np.array_split(order, 10):
                step += 1
                length = int(mask[part].sum(1).max())
                grads = self._gradient(win[part, :length], y[part, :length], mask[part, :length])
                lr = 0.12 if step < STEPS * 0.6 else 0.04
                for p, g, m, u in zip(params, grads, mom, vel):
                    g += 1e-4 * p
                    m *= 0.9
                    m += 0.1 * g
                    u *= 0.99
                    u += 0.01 * g * g
                    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-8)
        self.emit[:, self.unknown] = 0

    def _scores(self, win: np.ndarray) -> np.ndarray:
        return sum(self.emit[o][win[..., o]] for o in range(len(OFFSETS)))

    def _gradient(self, win: np.ndarray, y: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        b, t, _ = win.shape
        k = len(LABELS)
        e = self._scores(win).astype(np.float64)
        tr = np.exp((self.trans + self.block).astype(np.float64))
        a = np.zeros((b, t, k))
        c = np.ones((b, t))
        x = np.exp(e - e.max(-1, keepdims=True))
        start = np.exp(self.start.astype(np.float64))
        start[2::2] = 1e-13
        a[:, 0] = x[:, 0] * start
        for i in range(t):
            if i:
                a[:, i] = np.where(mask[:, i, None], (a[:, i - 1] @ tr) * x[:, i], a[:, i - 1])
            c[:, i] = a[:, i].sum(-1)
            a[:, i] /= c[:, i, None]
        beta = np.ones((b, k))
        gt = np.zeros((k, k))
        post = np.zeros((b, t, k))
        for i in range(t - 1, -1, -1):
            q = a[:, i] * beta
            q /= q.sum(-1, keepdims=True)
            post[:, i] = q
            if i:
                m = mask[:, i]
                xb = x[:, i] * beta
                pair = a[:, i - 1, :, None] * tr[None] * xb[:, None, :]
                z = pair.sum((1, 2), keepdims=True)
                gt += (pair[m] / z[m]).sum(0)
                nb = xb @ tr.T
                nb /= nb.sum(-1, keepdims=True) + 1e-300
                beta = np.where(m[:, None], nb * k, beta)
        flat = mask.ravel()
        d = post.reshape(-1, k)[flat]
        d[np.arange(len(d)), y.ravel()[flat]] -= 1
        d /= b
        ge = np.empty_like(self.emit)
        rows = win.reshape(-1, len(OFFSETS))[flat]
        for o in range(len(OFFSETS)):
            for j in range(k):
                ge[o, :, j] = np.bincount(rows[:, o], d[:, j], self.emit.shape[1])
        both = mask[:, 1:]
        np.subtract.at(gt, (y[:, :-1][both], y[:, 1:][both]), 1)
        gs = (post[:, 0] - np.eye(k)[y[:, 0]]).sum(0) / b
        return [ge, (gt / b).astype(np.float32), gs.astype(np.float32)]

    def _bounds(self) -> tuple[float, float]:
        """(most that one more token of a mention can gain by its transition, most that a mention gains by entering and leaving beyond that)."""
        tr = (self.trans + self.block).astype(np.float64)
        inside, stay = float(tr[1:, 1:].max()), float(tr[0, 0])
        enter = max(float(tr[0, 1:].max()) - stay, float((self.start[1::2] - self.start[0]).max()))
        return inside - stay, enter + max(0.0, float(tr[1:, 0].max()) - stay) + max(0.0, stay - inside)

    def decode(self, seqs: list[list[int]]) -> list[np.ndarray]:
        """Best label sequences by Viterbi, sentences of like length together.

        A sentence whose best mention cannot gain over no mention at all, by an upper bound on every run of its tokens,
        has no mention and needs no search; the labels are the same as with it.
        """
        out: list[np.ndarray] = [np.zeros(len(s), np.int8) for s in seqs]
        lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
        if not lengths.sum():
            return out
        gap = 3
        first_at = np.concatenate(([0], np.cumsum(lengths + gap)[:-1])) + gap
        flat = np.full(int(lengths.sum()) + gap * (len(seqs) + 1), self.pad, np.int64)
        place = np.arange(int(lengths.sum())) + np.repeat(gap * (np.arange(len(seqs)) + 1), lengths)
        flat[place] = np.fromiter((i for s in seqs for i in s), np.int64, len(place))
        e = self.emit[0][flat[place + OFFSETS[0]]]
        for o in range(1, len(OFFSETS)):
            e += self.emit[o][flat[place + OFFSETS[o]]]
        step, edge = self._bounds()
        gain = (e[:, 1:].max(1) - e[:, 0]).astype(np.float64) + max(step, 0.0)
        owner = np.repeat(np.arange(len(seqs)), lengths)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        total = np.concatenate(([0.0], np.cumsum(gain)))
        low = total[:-1] - owner * 1e7  # the least prefix sum of the same sentence: earlier sentences lie higher
        best = total[1:] - (np.minimum.accumulate(low) + owner * 1e7)
        may = np.zeros(len(seqs), np.bool_)
        may[owner[best + edge > -1e-3]] = True
        order = [i for i in np.argsort(lengths, kind="stable").tolist() if may[i]]
        lo = 0
        tr = self.trans + self.block
        first = self.start.copy()
        first[2::2] = -30
        while lo < len(order):
            n0 = len(seqs[order[lo]])
            hi = lo
            while hi < len(order) and len(seqs[order[hi]]) <= max(n0 * 1.15, n0 + 2) and (hi - lo) * (n0 + 2) < 60_000:
                hi += 1
            part = order[lo:hi]
            n = lengths[part]
            t = int(n.max())
            cell = np.minimum(np.arange(t)[None, :], n[:, None] - 1) + begin[part][:, None]
            score = e[cell]
            best_at = score[:, 0] + first
            back = np.zeros((len(part), t, len(LABELS)), np.int8)
            stay = np.arange(len(LABELS), dtype=np.int8)
            for i in range(1, t):
                s = best_at[:, :, None] + tr[None]
                arg = s.argmax(1)
                new = np.take_along_axis(s, arg[:, None, :], 1)[:, 0] + score[:, i]
                live = (i < n)[:, None]
                best_at = np.where(live, new, best_at)
                back[:, i] = np.where(live, arg, stay)
            y = best_at.argmax(1)
            path = np.empty((len(part), t), np.int8)
            for i in range(t - 1, -1, -1):
                path[:, i] = y
                y = back[np.arange(len(part)), i, y]
            for r, i in enumerate(part):
                out[i] = path[r, : len(seqs[i])]
            lo = hi
        return out


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    return Tagger()


_AT = r"(?:@|\s?@\s|\s?[(\[](?:at|AT)[)\]]\s?)"
_DOT = r"(?:\.|\s?[(\[](?:dot|DOT)[)\]]\s?)"
_EMAIL = re.compile(rf"[\w.+%-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+")
_PHONE = re.compile(r"(?:\+|00)?[\d(][\d\s./()\-]{5,}\d(?:\s?(?:ext\.?|x|poste|App\.|Durchwahl)\s?\d{1,5})?", re.I)
_ID = re.compile(r"(?=(?:\D*\d){4})[A-Z0-9](?:[A-Z0-9]|[ \-./](?=[A-Z0-9])){5,23}")
_EXT = re.compile(r"\s?(?:ext\.?|x)\s?\d{1,5}")
_TITLE = re.compile(r"^(?:(?:Dr|Prof|Mr|Mrs|Ms|Mme|Mlle|Sr|Sra|Herr|Frau)\b\.?\s+)+")
_NAME = re.compile(r"[^\W\d_][^\W\d_’'.\-]*\.?(?:[ \-’',]+[^\W\d_][^\W\d_]*\.?){1,4}")


_ALPHA = re.compile(r"(?<!\d)[^\W\d_]+")
# Words of names and of addresses that stand in small letters.
_PARTICLES = frozenset("de del la las los du des von van der den di da dos le y e bin ibn al".split())
_STREET = _PARTICLES | frozenset("rue allée avenue place quai chemin boulevard impasse cours route square passage calle avenida plaza paseo camino flat apt unit bis ter im am an zur zum les sur aux et d l".split())


def checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The exact mention under a decoded span, or None where the span has not the form of its kind."""
    if kind == "email":
        lo = max(0, start - 60)
        m = next((m for m in _EMAIL.finditer(text, lo, min(len(text), end + 60)) if m.start() < end and m.end() > start), None)
        return m.span() if m else None
    if kind == "phone":
        v = text[start:end].rstrip(" .,;:")
        end = start + len(v)
        if m := _EXT.match(text, end):
            end = m.end()
        if start and text[start - 1] in "+(":
            start -= 1
        v = text[start:end]
        digits = sum(c.isdigit() for c in v)
        return (start, end) if 7 <= digits <= 20 and _PHONE.fullmatch(v) else None
    if kind == "id_number":
        v = text[start:end].strip(" .,;:")
        return (text.index(v, start), text.index(v, start) + len(v)) if v and _ID.fullmatch(v) else None
    if kind == "street_address":
        v = text[start:end].strip(" ,;:")
        if v.endswith(".") and not re.search(r"\b(?:Ct|Rd|St|Ave|Blvd|Dr|Ln|Sq|Pl)\.$", v):
            v = v[:-1]
        at = text.index(v, start)
        words = _ALPHA.findall(v)
        good = words and len(words) < 14 and not v.isupper() and all(w[0].isupper() or w in _STREET for w in words) and any(w[0].isupper() for w in words)
        return (at, at + len(v)) if good and any(c.isdigit() for c in v) and " " in v else None
    v = text[start:end].strip(" ,;:()")
    if m := _TITLE.match(v):
        start = text.index(v, start) + m.end()
        v = v[m.end() :]
    if v.endswith(".") and not re.search(r"(?:^|[\s.])[^\W\d_]\.$", v):
        v = v[:-1]
    before, comma, after = v.partition(",")
    if comma and before.partition(" ")[0].lower() in _GIVEN and " " in before and after.strip().partition(" ")[0].lower() not in _GIVEN:
        v = before  # a full name before a comma is not the surname of what follows
    if not v or not _NAME.fullmatch(v) or not all(w[0].isupper() or w in _PARTICLES for w in _ALPHA.findall(v)) or sum(w[0].isupper() for w in _ALPHA.findall(v)) < 2:
        return None
    at = text.index(v, start)
    end = at + len(v)
    return at, end + (re.search(r"(?:^|[\s.])[^\W\d_]$", v) is not None and text[end : end + 1] == ".")


def mentions(texts: list[str], model: Tagger) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each mention of each text, in order and without overlap."""
    seqs: list[list[int]] = []
    where: list[tuple[int, list[tuple[int, int, str]]]] = []
    known = model.id
    for n, text in enumerate(texts):
        last = 0
        bounds = [m.span() for m in _SPLIT.finditer(text)]
        for a, b in [*bounds, (len(text), len(text))]:
            s = text[last:a]
            if s:
                tok = [(x + last, y + last, t) for x, y, t in tokens(s)]
                for lo in range(0, len(tok), 400):  # a line without sentence ends is decoded in overlapping runs
                    run = tok[max(0, lo - 20) : lo + 420]
                    seqs.append([known(t) for _, _, t in run])
                    where.append((n, run))
            last = b
    found: list[set[tuple[int, int, str]]] = [set() for _ in texts]
    for (n, run), y in zip(where, model.decode(seqs)):
        if not y.any():
            continue
        i = 0
        while i < len(y):
            if y[i] == 0:
                i += 1
                continue
            j, k = i + 1, (y[i] + 1) // 2
            while j < len(y) and y[j] == 2 * k:
                j += 1
            if m := checked(texts[n], run[i][0], run[j - 1][1], KINDS[k - 1]):
                found[n].add((*m, KINDS[k - 1]))
            i = j
    out = []
    for f in found:
        keep: list[tuple[int, int, str]] = []
        for m in sorted(f, key=lambda m: (m[0], -m[1])):
            if not keep or m[0] >= keep[-1][1]:
                keep.append(m)
        out.append(keep)
    return out


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, last = [], 0
    for s, e, k in found:
        parts += [text[last:s], f"[{k.upper()}]"]
        last = e
    return "".join([*parts, text[last:]])


def personal_data(documents: DataFrame, redact: bool = False) -> DataFrame:
    """(doc_id, kind, value), one row a distinct mention of a document; with redact, (doc_id, text, mentions) with typed placeholders.

    The model is trained on the driver from the labelled table of fixed size and sent to the executors; texts are
    processed whole, in batches. Null and empty texts have no mentions and are redacted to themselves.
    """
    model = documents.sparkSession.sparkContext.broadcast(tagger())
    st = T._parse_datatype_string("doc_id long, text string, mentions int" if redact else "doc_id long, kind string, value string")
    arrow = to_arrow_schema(st)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (size < 1 << 19 or hi == lo):
                    size += len(texts[hi] or "")
                    hi += 1
                found = mentions([t or "" for t in texts[lo:hi]], model.value)
                if redact:
                    rows = [(i, None if t is None else redacted(t, f), len(f)) for i, t, f in zip(ids[lo:hi], texts[lo:hi], found)]
                else:
                    rows = [(i, k, v) for i, t, f in zip(ids[lo:hi], texts[lo:hi], found) for k, v in dict.fromkeys((k, t[s:e]) for s, e, k in f)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                lo = hi

    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, st)
    return out.dropDuplicates(["doc_id"]) if redact else out.distinct()
