"""Toxic texts by a subsequence string-kernel SVM with Nystrom landmarks (operator 7).

The kernel of two strings sums over their common subsequences of three characters, each weighted ``DECAY`` to the power of
its span in either string, and is normalised; strings carry marks at both ends. Gaps and inserted characters only lengthen
spans, so ``idixot`` stays close to ``idiot``. Nystrom features against ``landmarks`` strings make the SVM linear.

A text is the bag of its strings, which are windows over its tokens without characters that aren't letters
(``i.d.i*o.t``): every token, every two neighbours joined (``id iot``, and insults of two words), and runs of three or more
tokens of at most ``SHORT`` letters joined (``i d i o t``). A text is toxic if one of its strings is. Labels are per text, so
training looks for the witnesses: strings that stand in several toxic texts and in too few others for chance, where pairs
count only in toxic texts without a toxic word. Each witness also trains with letters inserted at every place.

Two SVMs decide. The first, a gate, uses the kernel as it is: it is then a weighted sum of kernels with the landmarks, which
is one table over three-character subsequences (1 MB). It trains on witnesses and some clean strings, and its level lets
``PASSED`` of fresh variants through. All clean strings of the sample that pass train the second, whose kernel is sharpened to
``exp(GAMMA * (kernel - 1))`` so that what resembles a clean string more than an insult is told apart. What is learnt may show
further witnesses, so training is repeated. The threshold is set on a fifth of the texts by SVMs of the other four: that of
the fewest errors, or lower so that ``CAUGHT`` of fresh variants exceed it, as far as at most ``FLAGGED`` of the clean texts
do; joined pairs must exceed it by what keeps their part in this to an eighth.

Scale: scoring is a map over the scan; every distinct string of a slice is scored once by the table, an upper bound leaves
out, exactly, strings that can't pass the gate, and few pass. Tasks get a table and the landmarks (10 MB). At most ``sample``
labelled texts are trained on, those with the smallest hash of the id; nothing else is bounded by number.

Edge cases: a null or blank text is not toxic and has the margin ``FLOOR``; a null id is kept; repeated rows get equal
results; texts are read whole whatever their length, strings beyond ``MOST`` characters in overlapping windows; equal margins
are no ties, since texts are judged one by one; a label that is null, or an id that isn't among the documents, isn't trained
on, and of several labels of an id the largest counts; without toxic labels nothing is toxic; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import common

DECAY = 0.7
MOST = 32
#: Tokens of at most so many letters are joined in runs of three or more.
SHORT = 2
LANDMARKS = 400
SAMPLE = 4000
ROUNDS = 2
#: Clean strings that training starts from.
START = 8192
#: Letters that are drawn for each place of a witness.
DRAWS = 2
#: What a variant of a witness weighs; a witness weighs the number of its toxic texts.
VARIED = 8.0
#: How fast the sharpened kernel falls off.
GAMMA = 6.0
#: Shares of the witnesses' variants that are to pass the gate and to exceed the threshold, and of clean texts that may.
PASSED, CAUGHT, FLAGGED = 0.99, 0.97, 0.02
#: Bytes of text whose strings are taken together.
PART_BYTES = 2 << 20
#: Strings whose kernels are worked out together.
BLOCK = 4096
#: Margins are reported from here up.
FLOOR = -0.5
_ALPHABET = "^$abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøùúûüýÿßœ"
_SIZE = 64
_CODES = np.full(1 << 16, _SIZE - 1, np.uint8)
_CODES[[ord(c) for c in _ALPHABET]] = np.arange(1, len(_ALPHABET) + 1)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all words, one after the other, and where each starts."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    return _CODES[np.where(points < 1 << 16, points, 0)] if len(points) else np.zeros(0, np.uint8), at


@dataclass
class Strings:
    """The distinct strings of some texts: one word each, or two joined (``second`` is -1 for one).

    ``string`` and ``text`` have a row for each string of each text.
    """

    words: list[str]
    first: np.ndarray
    second: np.ndarray
    string: np.ndarray
    text: np.ndarray

    def __post_init__(self) -> None:
        self.flat, self.at = codes(self.words)
        length = np.diff(self.at)
        self.head = length[self.first]
        self.size = self.head + np.where(self.second >= 0, length[self.second], 0) if len(length) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.first)

    def __getitem__(self, i: int) -> str:
        return self.words[self.first[i]] + (self.words[self.second[i]] if self.second[i] >= 0 else "")

    def rows(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes of the strings ``which`` (-1 for none), with marks, a column each, in blocks of one size; and their places in ``which``.

        A string that is longer than ``MOST`` with its marks comes in several windows.
        """
        size = np.where(which < 0, 0, self.size[which])
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n)
            wide = n + 2
            block = max(1, BLOCK * MOST // max(wide, MOST))
            for a in range(0, len(own), block):
                part = own[a : a + block]
                i = which[part]
                p, head = np.arange(n)[:, None], self.head[i]
                second = np.where(self.second[i] >= 0, self.at[self.second[i]] - head, 0)
                x = np.empty((wide, len(part)), np.int32)
                x[1:-1] = self.flat[np.where(p < head, self.at[self.first[i]] + p, second + p)]
                x[0], x[-1] = 1, 2
                for s in range(0, max(1, wide - MOST // 2), MOST // 2) if wide > MOST else (0,):
                    yield x[s : s + MOST], part


def strings(texts: pa.Array) -> Strings:
    """All strings of texts."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().dictionary_encode()
    clean = pc.replace_substring_regex(flat.dictionary, r"[^\pL]+", "").dictionary_encode()
    words = clean.dictionary.to_pylist()
    code = clean.indices.to_numpy()[flat.indices.to_numpy()].astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    size = np.fromiter(map(len, words), np.int64, len(words))
    keep = size[code] > 0 if len(code) else np.zeros(0, bool)
    code, text = code[keep], text[keep]
    joint = text[1:] == text[:-1] if len(code) else np.zeros(0, bool)
    pair, back = np.unique(code[:-1][joint] * len(words) + code[1:][joint], return_inverse=True)
    n_words = len(words)
    short = np.flatnonzero(size[code] <= SHORT) if len(code) else np.zeros(0, np.int64)
    runs, owner = [], []
    if len(short) > 2:
        edge = np.concatenate([[0], np.flatnonzero((np.diff(short) != 1) | (np.diff(text[short]) != 0)) + 1, [len(short)]])
        for a, b in zip(edge[:-1][np.diff(edge) >= 3].tolist(), edge[1:][np.diff(edge) >= 3].tolist()):
            runs.append("".join([words[k] for k in code[short[a:b]].tolist()]))
            owner.append(int(text[short[a]]))
    words = words + runs
    none = np.full(len(words), -1)
    first, second = np.concatenate([np.arange(len(words)), pair // max(1, n_words)]), np.concatenate([none, pair % max(1, n_words)])
    string = np.concatenate([code, n_words + np.arange(len(runs)), len(words) + back])
    return Strings(words, first, second, string, np.concatenate([text, np.array(owner, np.int64), text[1:][joint]]))


def listed(words: list[str]) -> Strings:
    """Given words as strings, each of a text of its own."""
    here = np.arange(len(words))
    return Strings(words, here, np.full(len(words), -1), here, here)


def _triples(x: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Each three places: the subsequences there, and their weight, ``DECAY ** span``."""
    middle = x * _SIZE
    for k in range(2, len(x)):
        for i in range(k - 1):
            ends = x[i] * (_SIZE * _SIZE) + x[k]
            weight = DECAY ** (k - i + 1)
            for j in range(i + 1, k):
                yield ends + middle[j], weight


def self_kernel(x: np.ndarray) -> np.ndarray:
    """The kernel of each column with itself, by dynamic programming over all columns at once."""
    width, n = x.shape
    same = (x[:, None] == x[None]).astype(float)
    prime = np.ones((width + 1, width + 1, n))
    for _ in range(2):
        nxt = np.zeros_like(prime)
        for a in range(1, width + 1):
            running = np.zeros(n)
            for b in range(1, width + 1):
                running = DECAY * running + DECAY * DECAY * same[a - 1, b - 1] * prime[a - 1, b - 1]
                nxt[a, b] = DECAY * nxt[a - 1, b] + running
        prime = nxt
    return DECAY * DECAY * (same * prime[:-1, :-1]).sum((0, 1))


class Landmarks:
    """Kernels of strings with a fixed list of strings; only subsequences that these have are kept."""

    def __init__(self, words: list[str]):
        rows = [x for i in range(len(words)) for x, _ in listed(words).rows(np.array([i]))]
        found: list[dict[int, float]] = []
        for x in rows:
            own: dict[int, float] = {}
            for seq, weight in _triples(x):
                own[int(seq[0])] = own.get(int(seq[0]), 0.0) + weight
            found.append(own)
        known = sorted(set().union(*found))
        self.windows, self.place = rows, np.zeros(_SIZE**3, np.int32)
        self.place[known] = np.arange(1, len(known) + 1)
        self.weight = np.zeros((len(known) + 1, len(rows)), np.float32)
        for j, own in enumerate(found):
            length = np.sqrt(sum(v * v for v in own.values())) or 1.0
            for seq, v in own.items():
                self.weight[self.place[seq], j] = v / length

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Normalised kernels of each column with each landmark, some columns at once."""
        out, step = np.zeros((x.shape[1], self.weight.shape[1]), np.float32), 256
        for a in range(0, x.shape[1], step):
            part = x[:, a : a + step]
            n, known = part.shape[1], len(self.weight)
            total, row = np.zeros(n * known, np.float32), np.arange(n) * known
            for seq, weight in _triples(part):
                total[row + self.place[seq]] += np.float32(weight)
            total = total.reshape(n, known)
            total[:, 0] = 0
            out[a : a + n] = total @ self.weight / np.sqrt(np.maximum(self_kernel(part), 1e-300))[:, None]
        return out

    def of(self, s: Strings, which: np.ndarray) -> np.ndarray:
        """The same of strings; a long one has the largest of its windows."""
        out = np.zeros((len(which), self.weight.shape[1]), np.float32)
        for x, place in s.rows(which):
            out[place] = np.maximum(out[place], self.kernel(x))
        return out

    def table(self, beta: np.ndarray) -> np.ndarray:
        """The sum of the landmarks' subsequence weights, each times its part of ``beta``."""
        return (self.weight @ beta)[self.place].astype(np.float32)


def dot(x: np.ndarray, table: np.ndarray, least: float) -> np.ndarray:
    """Normalised product of each column's subsequence weights with ``table`` where it exceeds ``least``, else -inf.

    Subsequences that repeat only add to the length of a column's weights, so the length without repeats bounds the product,
    and most columns need no exact length.
    """
    width, n = x.shape
    last, first = np.tril_indices(width, -1)
    weight = DECAY ** (np.arange(width)[:, None] - first[None] + 1.0).astype(np.float32)
    out, plain, step = np.zeros(n, np.float32), 0.0, max(64, (1 << 16) // max(1, len(first)))
    for a in range(0, n, step):
        part = x[:, a : a + step]
        ends = part[first] * np.int32(_SIZE * _SIZE) + part[last] * np.int32(_SIZE)
        for k in range(2, width):
            m = k * (k - 1) // 2
            out[a : a + step] += weight[k, :m] @ table[ends[:m] + part[k]]
    for k in range(2, width):
        plain += float((weight[k, : k * (k - 1) // 2] ** 2).sum())
    result = np.full(n, -np.inf)
    open_ = np.flatnonzero(out > least * np.sqrt(plain) if least > 0 else np.full(n, True)) if plain else np.zeros(0, np.int64)
    if len(open_):
        found = out[open_] / np.sqrt(np.maximum(self_kernel(x[:, open_]), 1e-300))
        result[open_] = np.where(found > least, found, -np.inf)
    return result


@dataclass
class Model:
    """A gate, which is the table of a linear SVM and its bias, and the SVM of the sharpened kernel behind it."""

    table: np.ndarray | None = None
    bias: float = -1.0
    gate: float = 0.0
    marks: Landmarks | None = None
    beta: np.ndarray | None = None
    shift: float = -1.0
    joined: float = 0.0
    threshold: float = 0.0

    def gated(self, s: Strings, which: np.ndarray, least: float) -> np.ndarray:
        """The gate's margin for each string where it exceeds ``least``, else -inf; a long one has that of its best window."""
        out = np.full(len(which), -np.inf)
        for x, place in s.rows(which):
            out[place] = np.maximum(out[place], dot(x, self.table, least - self.bias) + self.bias)
        return out

    def margins(self, s: Strings) -> np.ndarray:
        """The margin for each string: ``FLOOR`` for those that the gate holds back, and at the least."""
        out = np.full(len(s), FLOOR)
        if self.table is not None:
            passed = np.flatnonzero(self.gated(s, np.arange(len(s)), self.gate) > -np.inf)
            passed = passed[np.argsort(s.size[passed], kind="stable")]
            for near in (passed[i : i + 4 * BLOCK] for i in range(0, len(passed), 4 * BLOCK)):
                out[near] = np.maximum(FLOOR, sharp(self.marks.of(s, near)) @ self.beta + self.shift - np.where(s.second[near] >= 0, self.joined, 0.0))
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text the best margin, and the number of strings above the threshold."""
        s = strings(texts)
        m = self.margins(s)
        best, hits = np.full(len(texts), FLOOR), np.zeros(len(texts), np.int64)
        if len(s.string):
            np.maximum.at(best, s.text, m[s.string])
            hits = np.bincount(s.text, m[s.string] > self.threshold, len(texts)).astype(np.int64)
        return best, hits


def sharp(k: np.ndarray) -> np.ndarray:
    """A kernel that falls off faster: one strings' neighbours weigh, and not what all have in common."""
    return np.exp(GAMMA * (k - 1))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps on the rows inside the margin, halved where they overshoot.

    The last column of ``x`` is 1, for the bias. Its numbers are of half precision and taken up a block of rows at a time.
    """
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])

    def reach(v: np.ndarray) -> np.ndarray:
        return y * np.concatenate([x[i : i + BLOCK].astype(np.float32) @ v.astype(np.float32) for i in range(0, len(x), BLOCK)]).astype(float)

    def loss(v: np.ndarray) -> float:
        return float((penalty * v * v).sum() + (cost * np.maximum(0, 1 - reach(v)) ** 2).sum())

    now = loss(w)
    for _ in range(steps):
        active = np.flatnonzero(reach(w) < 1)
        left, right = np.diag(penalty), np.zeros(len(penalty))
        for i in range(0, len(active), BLOCK):
            part = active[i : i + BLOCK]
            xa, ca = x[part].astype(float), cost[part]
            left += (xa * ca[:, None]).T @ xa
            right += xa.T @ (ca * y[part])
        to = np.linalg.solve(left, right)
        size = 1.0
        while size > 1e-4 and loss(w + size * (to - w)) > now:
            size /= 2
        w = w + size * (to - w)
        if now - (new := loss(w)) <= 1e-7 * now:
            break
        now = new
    return w[:-1], float(w[-1])


def inserted(word: str, rng: np.random.Generator) -> list[str]:
    """``word`` with a letter inserted, once at every inner place."""
    return [word[:at] + chr(97 + int(rng.integers(26))) + word[at:] for at in range(1, len(word))]


def _unlikely(bad: np.ndarray, seen: np.ndarray, share: float, tried: int) -> np.ndarray:
    """Whether so many toxic texts among those with a string are more than chance, of ``tried`` strings (Chernoff's bound)."""
    part = bad / np.maximum(seen, 1)
    return seen * part * np.log(np.maximum(part, 1e-9) / share) > np.log(max(1.0, tried * 0.02))


def _root(gram: np.ndarray) -> np.ndarray:
    value, vector = np.linalg.eigh((gram + gram.T).astype(np.float64) / 2)
    return (vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])).astype(np.float32)


def _fitted(marks: Landmarks, root: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray], parts: list[tuple[Strings, np.ndarray, float, np.ndarray]]) -> tuple[np.ndarray, float]:
    """The SVM of some strings by their kernels with ``marks``; each part has its strings, side and weights."""
    ends = np.cumsum([0] + [len(which) for _, which, _, _ in parts])
    x, y, cost = np.ones((ends[-1], root.shape[1] + 1), np.float16), np.empty(ends[-1]), np.empty(ends[-1])
    for (s, which, side, weight), at in zip(parts, ends.tolist()):
        order = np.argsort(s.size[which], kind="stable")
        y[at : at + len(which)], cost[at : at + len(which)] = side, weight[order]
        for i in range(0, len(which), BLOCK):
            own = which[order[i : i + BLOCK]]
            x[at + i : at + i + len(own), :-1] = kernel(marks.of(s, own)) @ root
    return _svm(x, y, cost)


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """The SVMs of all labelled texts, with thresholds by what those of four fifths give for the other fifth."""
    unique = {t: y for t, y in zip(texts, toxic)}
    own, y = list(unique), np.array(list(unique.values()))
    model, words = _trained(own, y, landmarks, rounds, seed)
    held = np.arange(len(own)) % 5 == 4
    part, _ = _trained([t for t, h in zip(own, held) if not h], y[~held], landmarks, rounds, seed) if model.table is not None else (model, [])
    if part.table is None:
        return model
    s = strings(pa.array([t for t, h in zip(own, held) if h], pa.string()))
    fresh = part.margins(listed([v for w in words for v in inserted(w, np.random.default_rng(seed + 1))]))
    m, bad = part.margins(s), y[held].astype(bool)

    def best(rows: np.ndarray) -> np.ndarray:
        out = np.full(len(bad), FLOOR)
        np.maximum.at(out, s.text[rows], m[s.string[rows]])
        return out

    alone = s.second[s.string] < 0
    single = best(alone)
    order = np.argsort(-single)
    caught = np.cumsum(bad[order])
    at = int(np.argmin(bad.sum() - caught + 2 * (np.arange(1, len(bad) + 1) - caught)))
    below = single[order[at + 1]] if at + 1 < len(bad) else single[order[at]] - 1
    most = lambda x, share: float(np.quantile(x[~bad], 1 - share)) if (~bad).any() else FLOOR
    model.threshold = max(FLOOR, min(float(single[order[at]] + below) / 2, max(float(np.quantile(fresh, 1 - CAUGHT)), most(single, FLAGGED))))
    model.joined = max(0.0, most(best(~alone), FLAGGED / 8) - model.threshold)
    return model


def _trained(texts: list[str], y: np.ndarray, landmarks: int, rounds: int, seed: int) -> tuple[Model, list[str]]:
    """Both SVMs, and the witnesses that counts alone show."""
    rng = np.random.default_rng(seed)
    if not len(y) or not y.any():
        return Model(), []
    s = strings(pa.array(texts, pa.string()))
    once = np.unique(s.text * len(s) + s.string)
    string, text = once % len(s), once // len(s)
    s.string = s.text = np.zeros(0, np.int64)
    del once
    bad = np.bincount(string, y[text], len(s))
    seen = np.bincount(string, minlength=len(s))
    good, share, single = seen - bad, y.mean(), s.second < 0
    witness = single & (s.size >= 3) & (bad >= 3) & (good <= 0.05 * bad) & _unlikely(bad, seen, share, int(single.sum()))

    def explained() -> np.ndarray:
        return ~single & (witness[s.first] | witness[np.maximum(s.second, 0)])

    # only toxic texts without a toxic word tell of toxic pairs of words
    open_ = y.astype(bool)
    open_[text[witness[string]]] = False
    left = np.bincount(string, open_[text], len(s))
    if open_.any():
        witness |= ~single & (s.size >= 3) & (left >= 3) & (good <= 0.05 * left) & ~explained() & _unlikely(left, left + good, open_.mean(), int((~single & (seen >= 3)).sum()))
    if not witness.any():
        return Model(), []
    del string, text
    sure = [s[i] for i in np.flatnonzero(witness)]
    clean = (s.size >= 2) & (good > 0) & (bad <= share * 2 * seen + 3)
    model = Model()
    for _ in range(rounds):
        positive = np.flatnonzero(witness)
        first = positive[np.argsort(-bad[positive], kind="stable")][: landmarks // 2]
        varied = listed([v for i in positive for _ in range(DRAWS) for v in inserted(s[i], rng)])
        pool = np.flatnonzero(clean & ~witness & ~explained())
        drawn = rng.choice(pool, min(START, len(pool)), replace=False)
        chosen = Landmarks([s[i] for i in np.concatenate([first, drawn[: landmarks - len(first)]])])
        root = _root(np.concatenate([chosen.kernel(x) for x in chosen.windows]))
        each = max(1.0, len(drawn) / (len(positive) + len(varied)))
        all_varied = np.arange(len(varied))
        w, b = _fitted(chosen, root, lambda k: k, [(s, positive, 1, np.full(len(positive), each)), (varied, all_varied, 1, np.full(len(varied), each)), (s, drawn, -1, np.ones(len(drawn)))])
        model = Model(chosen.table(root @ w.astype(np.float32)), b)
        fresh = listed([v for i in positive for _ in range(DRAWS) for v in inserted(s[i], rng)])
        model.gate = float(np.quantile(np.maximum(-1.0, model.gated(fresh, np.arange(len(fresh)), -1.0)), 1 - PASSED))
        # all clean strings that pass train the second SVM, each by the number of its texts
        near = pool[model.gated(s, pool, model.gate) > -np.inf]
        witnessed = Landmarks([s[i] for i in first])
        close = np.concatenate([np.zeros(0), *(sharp(witnessed.of(s, near[i : i + BLOCK]).max(1)) for i in range(0, len(near), BLOCK))])
        hard = near[np.argsort(-good[near] * close, kind="stable")][: landmarks // 2]
        model.marks = Landmarks([s[i] for i in np.concatenate([first, hard])] + [varied.words[i] for i in rng.choice(len(varied), min(landmarks // 4, len(varied)), replace=False)])
        root = _root(sharp(np.concatenate([model.marks.kernel(x) for x in model.marks.windows])))
        w, model.shift = _fitted(model.marks, root, sharp, [(s, positive, 1, bad[positive]), (varied, all_varied, 1, np.full(len(varied), VARIED)), (s, near, -1, good[near].astype(float))])
        model.beta = root @ w.astype(np.float32)
        margin = model.margins(s)
        witness |= (s.size >= 3) & (np.where(single, bad, left) >= 2) & (good == 0) & (margin > 0.5) & ~explained()
    return model, sure


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled documents, those with the smallest hash of the id."""
    own = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    own = own.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    got = sorted((r["i"], r["t"], r["y"]) for r in texts.join(F.broadcast(own), "i").collect())
    return train([x[1] for x in got], [x[2] for x in got])


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, toxic, margin, hits)`` of every document: the best margin, and the number of toxic strings."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in common.slices(whole.column(1), PART_BYTES)):
            best, hits = m.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits > 0), pa.array(best.round(6)), pa.array(hits)], ["doc_id", "toxic", "margin", "hits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, toxic boolean, margin double, hits long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, fit(docs, labels)).where("toxic")
