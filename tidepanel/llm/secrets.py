"""Operator 3: secret spans by base patterns and a linear-chain conditional random field.

Tokens are runs of the characters that secrets use, or single marks.  Every token of a text is scored, and the best labelling of the
whole text is found: a bound on what a run of tagged tokens can gain tells where the best labelling is outside, and the stretches between are
decoded one by one, with the transitions from and to the tokens beside them.  Labels are begin, inside and outside; features are the
shape, length, variety, changes of character class and key words of a token and its neighbours in the whole
text, and of the whole file.  Weights are fitted by maximum likelihood on a bounded sample: weak labels from the base patterns around
triggers (a digit, a mark that assigns or joins, a colon, a key word, or a very long word),
and strings drawn by rule and planted in the corpus's own prose, every token of which is learned from, so that shape and context have to carry where
no base pattern looks: secrets of many alphabets with and without a key word before them, and
look-alikes (versions, dates, paths, hosts, ids, numbers) that are none.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textcodes as tc
from tidepanel.llm.store import small_batches, written

# The base patterns and their least lengths (assign: of group 2).
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "crf")
HINTS = ("passw", "secret", "token", "api")

TRIGGER = re.compile(r"[0-9=:_+/]|(?:pass|pwd|secret|token|cred|auth|key)|[A-Za-z]{24,}", re.A | re.I)
TOKEN = re.compile(r"[A-Za-z0-9_+/.-]+|[=:\"']", re.A)
SPACE = re.compile(r"[\x20\x09-\x0D]")
KEY = re.compile(r"pass|pwd|secret|token|cred|auth|key", re.I | re.A)
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
REACH = 24
#: Places of the neighbours that bear on a token; slack of the bound on runs; bytes of words, and of texts, that are taken together.
BESIDE = (-3, -2, -1, 1, 2)
SLACK, RUN = 1e-6, 1 << 19
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
CLASSES = str.maketrans({**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("0123456789", "9"), **dict.fromkeys("_+/.-", "-")})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, ascending."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def digest_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _token_start(text: str, a: int) -> int:
    """The place after the last white space before ``a``."""
    width = 64
    while a > 0:
        lo = max(0, a - width)
        k = max(text.rfind(c, lo, a) for c in BLANKS)
        if k >= 0:
            return k + 1
        a, width = lo, 4 * width
    return 0


def segments(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token bounds of each stretch around triggers; between two stretches there is a token of neither.

    A stretch reaches ``REACH`` characters to either side and on to the next white space;
    a trigger inside it extends it by its own reach.
    """
    lo = hi = -1
    n = len(text)
    for m in TRIGGER.finditer(text):
        found = SPACE.search(text, min(n, m.end() + REACH))
        b = found.start() if found else n
        if m.start() >= hi:
            a = _token_start(text, max(0, m.start() - REACH)) if m.start() > REACH else 0
            if a > hi and (hi < 0 or TOKEN.search(text, hi, a)):
                if hi > lo:
                    yield from _tokens(text, lo, hi)
                lo = a
        hi = max(hi, b)
    if hi > lo:
        yield from _tokens(text, lo, hi)


def _tokens(text: str, lo: int, hi: int) -> Iterator[list[tuple[int, int]]]:
    found = [t.span() for t in TOKEN.finditer(text, lo, hi)]
    if found:
        yield found


def _step(part: float) -> int:
    return min(3, int(4 * part))


def shape(word: str) -> str:
    """Character classes in it, with its length and variety in coarse steps."""
    classes = ("a" if word.upper() != word and re.search("[a-z]", word) else "") + ("A" if re.search("[A-Z]", word) else "") + ("9" if re.search("[0-9]", word) else "") + ("-" if re.search("[_+/.-]", word) else "")
    if len(word) == 1 and not classes:
        return word
    size = next(s for s in (1, 3, 6, 10, 16, 24, 40, 10**9) if len(word) <= s)
    variety = min(9, 10 * len(set(word)) // min(64, len(word)))
    return f"{classes}{size}v{variety // 3}"


def inside(word: str) -> tuple[str, ...]:
    """How a word mixes classes: changes between neighbours, shares of digits, vowels and marks, and its longest run of letters."""
    n = len(word)
    if n < 6:
        return ("in:short",)
    kinds = word.translate(CLASSES)
    changes = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) / (n - 1)
    letters = n - kinds.count("9") - kinds.count("-")
    vowels = sum(map(word.lower().count, "aeiou")) / max(1, letters)
    longest = max(map(len, re.split("[^a]", kinds)))
    return (f"in:c{_step(changes)}", f"in:d{_step(kinds.count('9') / n)}", f"in:v{_step(2 * vowels)}", f"in:m{min(3, kinds.count('-'))}", f"in:r{min(3, longest // 4)}", f"in:c{_step(changes)}n{n > 15}")


def file_features(text: str) -> tuple[str, ...]:
    lines = text.count("\n") + 1
    return (f"f:assigns{min(3, text.count('=') // lines)}", f"f:braces{int('{' in text or ';' in text)}", f"f:long{int(len(text) > 2000)}")


def around(text: str, bounds: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The bounds of up to three tokens before a segment and two after it, in the whole text."""
    before, at, width = [], bounds[0][0], 64
    while True:
        start = max(0, at - width)
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        before = [t.span() for t in TOKEN.finditer(text, start, at)][-3:]
        if len(before) == 3 or start == 0:
            break
        width *= 4
    after = []
    for t in TOKEN.finditer(text, bounds[-1][1]):
        after.append(t.span())
        if len(after) == 2:
            break
    return before, after


def own_features(word: str, form: str, key: str) -> list[str]:
    return ["bias", *inside(word), f"s:{form}", f"key{key}", f"hex{int(len(word) > 15 and not word.strip('0123456789abcdef'))}"]


def features(text: str, bounds: list[tuple[int, int]], of_file: tuple[str, ...], beside=None) -> list[list[str]]:
    before, after = beside or around(text, bounds)
    first, last = len(before), len(before) + len(bounds)
    bounds = [*before, *bounds, *after]
    words = [text[a:b] for a, b in bounds]
    shapes = [shape(w) for w in words]
    keys = ["k" if KEY.search(w) else "" for w in words]
    out, n = [], len(words)
    for i, w in enumerate(words[first:last], first):
        own = [*own_features(w, shapes[i], keys[i]), *of_file]
        for d in BESIDE:
            j = i + d
            own.append(f"s{d}:{shapes[j]}{keys[j]}" if 0 <= j < n else f"s{d}:edge")
        own.append("glued" if i and bounds[i - 1][1] == bounds[i][0] else "free")
        out.append(own)
    return out


def weak_labels(bounds: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Begin, inside or outside, from the base spans that overlap each token."""
    out, last = [], None
    for a, b in bounds:
        own = next((s for s in spans if s[0] < b and a < s[2]), None)
        out.append(OUTSIDE if own is None else INSIDE if own == last else BEGIN)
        last = own
    return out


@dataclass(frozen=True)
class CRF:
    """``emit[feature]`` and ``move[from, to]`` weights of the three labels."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def weight(self, own: list[str]) -> np.ndarray:
        return self.emit[[self.index[f] for f in own if f in self.index]].sum(0)

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        return np.array([self.weight(own) for own in feats])

    @cached_property
    def words(self) -> _Words:
        return _Words(self)


class _Words:
    """What a word adds to the scores of its own token and of those beside it, looked up once for all words of one code."""

    def __init__(self, crf: CRF) -> None:
        self.crf = crf
        self.code, self.own, self.form = np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros(0, np.int64)
        self.forms: dict[str, int] = {}
        self.beside = np.zeros((0, len(BESIDE), 3))
        self.edge = self._formed("edge")

    def _formed(self, name: str) -> int:
        if name not in self.forms:
            self.forms[name] = len(self.forms)
            self.beside = np.concatenate([self.beside, [[self.crf.weight([f"s{d}:{name}"]) for d in BESIDE]]])
        return self.forms[name]

    def _learn(self, code: np.ndarray, words: list[str]) -> None:
        form, key = [shape(w) for w in words], ["k" if KEY.search(w) else "" for w in words]
        own = [self.crf.weight(own_features(*x)) for x in zip(words, form, key, strict=True)]
        code = np.concatenate([self.code, code])
        order = np.argsort(code)
        self.code, self.own = code[order], np.concatenate([self.own, own])[order]
        self.form = np.concatenate([self.form, [self._formed(f + k) for f, k in zip(form, key, strict=True)]])[order]

    def places(self, code: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where ``own`` and ``form`` hold each token's; a code that is new is learned from one token that has it."""
        new = ~np.isin(code, self.code)
        if new.any():
            found, first = np.unique(code[new], return_index=True)
            at = np.flatnonzero(new)[first]
            self._learn(found, [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        return np.searchsorted(self.code, code)


def _bytes_in(characters: str) -> np.ndarray:
    return np.isin(np.arange(256), list(characters.encode()))


LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_LOWER, _UPPER, _DIGIT, _MARK, _VOWEL, _HEX = map(_bytes_in, (LETTERS, LETTERS.upper(), DIGITS, "_+/.-", "aeiouAEIOU", DIGITS + "abcdef"))
_INNER, _ALONE = _LOWER | _UPPER | _DIGIT | _MARK, _bytes_in("=:\"'")
_CLASS = _UPPER + 2 * _DIGIT + 3 * _MARK
#: A bit for each character of words, in two numbers.
_BITS = [np.where(part, np.uint64(1) << (np.cumsum(part) - 1).clip(0).astype(np.uint64), np.uint64(0)) for part in (_LOWER | _UPPER | _DIGIT, _MARK)]
_SIZES = np.array([1, 3, 6, 10, 16, 24, 40])
_KEY = re.compile(KEY.pattern.encode())


def _token_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in bytes of the runs and single marks that ``TOKEN`` finds."""
    inner, alone = np.concatenate([[False], _INNER[data], [False]]), np.concatenate([[False], _ALONE[data], [False]])
    starts = alone[1:] | inner[1:] & ~inner[:-1]
    ends = alone[:-1] | inner[:-1] & ~inner[1:]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keyed: np.ndarray) -> np.ndarray:
    """A number for each token; tokens of equal numbers have equal ``own_features`` and equal ``shape``."""
    n = ends - starts
    at = np.cumsum(n) - n
    x = data[np.arange(int(n.sum())) + np.repeat(starts - at, n)]
    count = lambda table: np.add.reduceat(table[x], at, dtype=np.int64)
    lower, upper, digits, marks, hexes = map(count, (_LOWER, _UPPER, _DIGIT, _MARK, _HEX))
    distinct = sum(np.bitwise_count(np.bitwise_or.reduceat(bits[x], at)).astype(np.int64) for bits in _BITS)
    variety = np.minimum(9, 10 * distinct // np.minimum(64, n)) // 3
    kind = _CLASS[x]
    turned = np.concatenate([[False], kind[1:] != kind[:-1]])
    turned[at] = False
    changes = np.add.reduceat(turned, at, dtype=np.int64) / np.maximum(1, n - 1)
    vowels = count(_VOWEL) / np.maximum(1, n - digits - marks)
    place, low = np.arange(1, len(x) + 1), _LOWER[x]
    before = np.where(low, 0, place)
    before[at] = np.where(low[at], at, at + 1)
    run = np.maximum.reduceat(place - np.maximum.accumulate(before), at)
    step = lambda part: np.minimum(3, (4 * part).astype(np.int64))
    mixed = [(step(changes), 4), (step(digits / n), 4), (step(2 * vowels), 4), (np.minimum(3, marks), 4), (np.minimum(3, run // 4), 4), (n > 15, 2)]
    plain = [(n >= 6, 2), (lower > 0, 2), (upper > 0, 2), (digits > 0, 2), (marks > 0, 2), (np.searchsorted(_SIZES, n), 8), (variety, 4), (keyed, 2), ((n > 15) & (hexes == n), 2)]
    code = np.where(_ALONE[x[at]], x[at], 0).astype(np.int64)
    for value, many in plain:
        code = code * many + value
    for value, many in mixed:
        code = code * many + np.where(n >= 6, value, 0)
    return code


def chunk_scores(texts: list[str], model: CRF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts together: where each one's tokens begin among all, token bounds in its own code points, and label scores.

    The scores are those of ``model.scores(features(...))`` over all tokens of each text; words are taken in runs of about ``RUN`` bytes.
    """
    known = model.words
    data = "\n".join(texts).encode(errors="surrogatepass")
    x = np.frombuffer(data, np.uint8)
    starts, ends = _token_bounds(x)
    sizes = [len(t) if t.isascii() else len(t.encode(errors="surrogatepass")) for t in texts]
    begins = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])  # of texts in bytes; one more byte lies between two
    first = np.searchsorted(starts, begins)
    if not len(starts):
        return first, np.zeros((0, 2), np.int64), np.zeros((0, 3))
    keyed = np.zeros(len(starts), bool)
    keyed[np.searchsorted(starts, [m.start() for m in _KEY.finditer(data.lower())], "right") - 1] = True
    code, i = np.zeros(len(starts), np.int64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + RUN, "right")))
        code[i:j] = _codes(x, starts[i:j], ends[i:j], keyed[i:j])
        i = j
    places = known.places(code, data, starts, ends)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    of_file = np.array([model.weight(list(file_features(t))) if a < b else np.zeros(3) for t, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True)])
    emit = known.own[places] + of_file[text]
    form = np.full(len(starts) + 3 * len(texts) + 3, known.edge)  # three edges before, between and after texts
    own = np.arange(len(starts)) + 3 * (text + 1)
    form[own] = known.form[places]
    for j, d in enumerate(BESIDE):
        emit += known.beside[form[own + d], j]
    glued = np.concatenate([[False], starts[1:] == ends[:-1]])
    emit += np.where(glued[:, None], model.weight(["glued"]), model.weight(["free"]))
    bounds = np.stack([starts, ends], 1)
    if len(data) > sum(map(len, texts)) + len(texts) - 1:
        before = np.concatenate([[0], np.cumsum((x & 0xC0) != 0x80)])
        bounds, begins = before[bounds], before[np.minimum(begins, len(x))]
    return first, bounds - begins[text][:, None], emit


def token_scores(text: str, model: CRF) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and label scores of every token of the text: those of ``model.scores(features(...))``."""
    return chunk_scores([text], model)[1:]


def open_tokens(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Where the best labelling may be other than outside: tokens of some run that may score, tagged, no less than outside.

    Each tagged token gains at most its own best score over outside and the best step into a tagged token, the end of a run the best step out of one.
    """
    tagged = [BEGIN, INSIDE]
    gain = emit[:, tagged].max(1) - emit[:, OUTSIDE]
    gain[1:] += move[:, tagged].max() - move[OUTSIDE, OUTSIDE]
    upto = np.cumsum(gain)
    best_end = np.maximum.accumulate(upto[::-1])[::-1]
    least_start = np.minimum.accumulate(np.concatenate([[0.0], upto[:-1]]))
    return best_end - least_start + max(0.0, (move[tagged, OUTSIDE] - move[OUTSIDE, OUTSIDE]).max()) >= -SLACK


def viterbi(emit: np.ndarray, move: np.ndarray, before: bool = False, after: bool = False) -> list[int]:
    """The best label sequence; ``before`` and ``after`` tell of tokens there that are held outside."""
    score, back = emit[0] + (move[OUTSIDE] if before else 0), []
    for e in emit[1:]:
        step = score[:, None] + move
        back.append(step.argmax(0))
        score = step.max(0) + e
    out = [int((score + (move[:, OUTSIDE] if after else 0)).argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def fit_crf(sequences: list[tuple[list[list[str]], list[int]]], steps: int = 120, rate: float = 0.15, penalty: float = 1e-4, longest: int = 96) -> CRF:
    """Maximum likelihood with an L2 penalty, by Adam on the exact gradient (forward-backward).

    Sequences of more than ``longest`` tokens are fitted in parts of so many; none is left out.
    """
    parts = ((f[k : k + longest], y[k : k + longest]) for f, y in sequences for k in range(0, len(f), longest))
    sequences = sorted(parts, key=lambda s: (len(s[0]), str(s)))
    names = sorted({f for fs, _ in sequences for own in fs for f in own})
    index = {f: i for i, f in enumerate(names)}
    emit, move = np.zeros((len(names), 3)), np.zeros((3, 3))
    if not sequences:
        emit = np.zeros((1, 3))
        emit[0, OUTSIDE] = 1.0
        return CRF({"bias": 0}, emit, move)
    n, t = len(sequences), max(len(f) for f, _ in sequences)
    rows, cols, gold, mask = [], [], np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (fs, y) in enumerate(sequences):
        mask[i, : len(y)] = True
        gold[i, : len(y)] = y
        for k, own in enumerate(fs):
            rows += [i * t + k] * len(own)
            cols += [index[f] for f in own]
    rows, cols = np.array(rows), np.array(cols)
    length = mask.sum(1)  # ascending, so the sequences that reach step k are the last ones
    reach = np.searchsorted(length, np.arange(t), "right")
    at, pair = np.flatnonzero(mask), np.flatnonzero(mask[:, 1:] & mask[:, :-1])
    pair = pair // max(1, t - 1) * t + pair % max(1, t - 1)  # the place of the first of each two
    onehot = np.eye(3)[gold.reshape(-1)]
    seen = onehot[pair].T @ onehot[pair + 1]
    m1, m2 = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, steps + 1):
        e = np.stack([np.bincount(rows, emit[cols, c], n * t) for c in range(3)], 1).reshape(n, t, 3)
        ahead, behind = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        ahead[:, 0] = e[:, 0]
        for k in range(1, t):
            r = slice(reach[k], None)
            ahead[r, k] = _log_sum(ahead[r, k - 1, :, None] + move, 1) + e[r, k]
        total = _log_sum(ahead[np.arange(n), length - 1], 1)
        for k in range(t - 2, -1, -1):
            r = slice(reach[k + 1], None)
            behind[r, k] = _log_sum(move + (e[r, k + 1] + behind[r, k + 1])[:, None, :], 2)
        e, ahead, behind = (x.reshape(n * t, 3) for x in (e, ahead, behind))
        gap = np.zeros((n * t, 3))
        gap[at] = onehot[at] - np.exp(ahead[at] + behind[at] - total[at // t, None])
        both = np.exp(ahead[pair, :, None] + move + (e[pair + 1] + behind[pair + 1])[:, None, :] - total[pair // t, None, None])
        slopes = [np.stack([np.bincount(cols, gap[rows, c], len(names)) for c in range(3)], 1) / n - penalty * emit, (seen - both.sum(0)) / n - penalty * move]
        for w, g, a, b in zip((emit, move), slopes, m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return CRF(index, emit, move)


def _decoded(text: str, bounds: np.ndarray, emit: np.ndarray, move: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    if not len(bounds):
        return out
    maybe = open_tokens(emit, move)
    if not maybe.any():
        return out
    maybe = np.concatenate([[False], maybe, [False]])
    for lo, hi in np.flatnonzero(maybe[1:] != maybe[:-1]).reshape(-1, 2).tolist():
        labels = viterbi(emit[lo:hi], move, lo > 0, hi < len(bounds))
        opened = False
        for (a, b), y in zip(bounds[lo:hi].tolist(), labels, strict=True):
            if y == OUTSIDE:
                opened = False
            elif y == BEGIN or not opened:
                out.append((a, b))
                opened = True
            else:
                out[-1] = (out[-1][0], b)
    return [(a, a + len(text[a:b].rstrip("."))) for a, b in out]


def crf_spans(text: str, model: CRF) -> list[tuple[int, int]]:
    """Spans that the model tags in the best labelling of all tokens of the text; a full stop at the end is not part of one."""
    return _decoded(text, *token_scores(text, model), model.move)


def chunk_spans(texts: list[str], model: CRF) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Per text its base spans, and those plus the model's spans that overlap none of them and could hold a secret."""
    first, bounds, emit = chunk_scores(texts, model)
    for text, i, j in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True):
        base = base_spans(text)
        more = [(a, 3, b) for a, b in _decoded(text, bounds[i:j], emit[i:j], model.move) if b - a >= ASSIGN_LEAST and not any(a < y and x < b for x, _, y in base)]
        yield base, sorted(base + more)


def all_spans(text: str, model: CRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``chunk_spans`` of one text."""
    return next(chunk_spans([text], model))


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """Whole texts in runs of about ``RUN`` characters; null is empty."""
    own, size = [], 0
    for text in texts:
        own.append(text or "")
        size += len(own[-1])
        if size >= RUN:
            yield own
            own, size = [], 0
    if own:
        yield own


def drawn_secret(rng: random.Random) -> tuple[str, str]:
    """What may stand before a secret, and a value of 16 to 64 characters from one of the usual alphabets."""
    alphabet = rng.choice((LETTERS + LETTERS.upper() + DIGITS, LETTERS + LETTERS.upper() + DIGITS + "-_", LETTERS + LETTERS.upper() + DIGITS + "+/", "0123456789abcdef", LETTERS.upper() + DIGITS, LETTERS + DIGITS))
    head = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(2, 5))) + rng.choice("_-") if rng.random() < 0.4 else ""
    lead = rng.choice(("", "", "", "", "key ", "the token is ", "Bearer ", "Authorization: Bearer ", "credentials: ", "pass ", "auth "))
    return lead, head + "".join(rng.choice(alphabet) for _ in range(rng.randrange(16, 65)))


def drawn_lookalike(rng: random.Random, words: list[str]) -> str:
    """A string with digits, marks or capitals that is no secret."""
    number = lambda n: "".join(rng.choice(DIGITS) for _ in range(n))
    word = lambda: rng.choice(words)
    return rng.choice((
        lambda: f"v{rng.randrange(20)}.{rng.randrange(40)}.{rng.randrange(99)}-{rng.choice(('rc1', 'beta', 'final', 'SNAPSHOT'))}",
        lambda: f"20{number(2)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}T1{rng.randrange(10)}:{rng.randrange(10, 60)}:{rng.randrange(10, 60)}.{number(3)}",
        lambda: f"/{word()}/{word()}/{word()}{rng.randrange(9)}/{word()}.{rng.choice(('py', 'txt', 'html', 'json'))}",
        lambda: f"{word()}.{number(2)}@{word()}{rng.randrange(99)}.{word()}.com",
        lambda: f"https://{word()}.{word()}.org/{word()}-{word()}-{word()}/{number(6)}",
        lambda: f"{rng.choice(('INV', 'ORD', 'RFC', 'ISBN'))}-{number(4)}-{number(6)}",
        lambda: "-".join("".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
        lambda: f"+{number(2)} {number(3)} {number(7)}",
        lambda: f"{rng.choice(('DE', 'FR', 'ES'))}{number(20)}",
        lambda: number(rng.randrange(4, 20)),
        lambda: word() + word().capitalize() + word().capitalize() + rng.choice(("", "2", "Id")),
        lambda: f"{word()}_{word()}_{word()}={rng.randrange(9999)}",
        lambda: f"commit {''.join(rng.choice('0123456789abcdef') for _ in range(7))}",
        lambda: word() + word() + word() + word(),
    ))()


def planted(text: str, at: int, rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """Prose around ``at`` with a drawn string in it, and the span of that if it is a secret."""
    near = text[max(0, at - 60) : at + 60]
    words = re.findall("[a-z]{3,}", near) or ["one", "two"]
    left, _, right = near.partition(" ")[2].rpartition(" ")[0].partition(" ") if rng.random() < 0.2 else (near[: len(near) // 2].rpartition(" ")[0], "", near[len(near) // 2 :].partition(" ")[2])
    if rng.random() < 0.5:
        return f"{left} {drawn_lookalike(rng, words)} {right}", []
    lead, value = drawn_secret(rng)
    start = len(left) + 1 + len(lead)
    return f"{left} {lead}{value}{rng.choice(('', '', '.', ','))} {right}", [(start, 3, start + len(value))]


def _examples(text: str, key: int, keep: int, plants: float) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Feature and label sequences of a text's segments with base spans, of some others, with a token to either side, and of planted strings with all prose around."""
    of_file, rng = file_features(text), random.Random(key)

    def example(own: str, bounds: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> tuple[list[list[str]], list[int]]:
        before, after = around(own, bounds)
        wide = [*before[-1:], *bounds, *after[:1]]
        return features(own, wide, of_file), weak_labels(wide, spans)

    base = base_spans(text)
    for k, bounds in enumerate(segments(text)):
        some = any(a < bounds[-1][1] and bounds[0][0] < b for a, _, b in base)
        if some or (key + k) % keep == 0:
            yield example(text, bounds, base)
    for _ in range(int(plants + rng.random()) if len(text) > 40 else 0):
        made, spans = planted(text, rng.randrange(len(text)), rng)
        every = [t.span() for t in TOKEN.finditer(made)]
        if every:
            yield features(made, every, of_file), weak_labels(every, base_spans(made) + spans)


def _training(keep: int, plants: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.slices(batches):
            order, feats, labels, positive = [], [], [], []
            for key, text in zip(batch.column("draw").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for f, y in _examples(text or "", key, keep, plants):
                    order.append(key)
                    positive.append(any(v != OUTSIDE for v in y))
                    feats.append([" ".join(own) for own in f])
                    labels.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(positive, pa.bool_()), pa.array(feats, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.int32()))], names=["draw", "positive", "feats", "labels"])

    return run


def fit(docs: DataFrame, texts: int = 40_000, segments_each: int = 1_200, keep: int = 8, plants: float = 6.0, text_col: str = "text") -> CRF:
    """Fit on about ``texts`` whole texts drawn by hash, at most ``segments_each`` segments with and without a secret.

    Of each text, segments with a base span are used, a ``keep``-th of the others, and strings are planted at random places:
    up to 4 in a text, fewer where about ``plants`` times ``segments_each`` suffice.  Null texts are empty; repeated rows are drawn together; ties of the draw go by the features.
    Without texts, or without segments, the model tags nothing.
    """
    small_batches(docs.sparkSession)
    total = docs.count()
    draw = F.pmod(F.xxhash64(F.col(text_col), F.lit(3)), F.lit(1_000_000_007))
    sample = docs.select(F.col(text_col).alias("text"), draw.alias("draw")).where(F.col("draw") < int(1_000_000_007 * min(1.0, texts / max(1, total))))
    each = min(4.0, plants * segments_each / max(1, min(total, texts)))
    found = written(sample.mapInArrow(_training(keep, each), "draw long, positive boolean, feats array<string>, labels array<int>"), "segments")
    sequences = []
    for kind in (True, False):
        order = F.xxhash64("draw", F.concat_ws("|", "feats")), F.concat_ws("|", "feats")
        rows = found.where(F.col("positive") == kind).orderBy(*order).limit(segments_each).collect()
        sequences += [([f.split(" ") for f in r["feats"]], list(r["labels"])) for r in rows]
    return fit_crf(sequences)


def _scanned(parts, names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CRF(*parts.value)
        for batch in tc.slices(batches):
            counts, base_text, every = [], [], []
            for base, spans in (found for own in _chunks(batch.column(text_col).to_pylist()) for found in chunk_spans(own, model)):
                kinds = [k for _, k, _ in base]
                counts.append([kinds.count(k) for k in range(3)])
                base_text.append(digest_text(base))
                every.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(base_text, pa.string()), pa.array(every, _SPANS)], names=[*names, "n_assign", "n_access", "n_hex", "base_spans", "secret_spans"])

    return run


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
ADDED = ("n_assign", "n_access", "n_hex", "base_spans", "secret_spans")


def scan(docs: DataFrame, model: CRF, text_col: str = "text") -> DataFrame:
    """``docs`` with counts of base spans, their joined text, and ``secret_spans`` (base and added).

    Spans are in code points, end exclusive.  A null text is empty.  Every row is scanned as
    a whole; repeated rows get equal results; columns of the added names are replaced; an
    empty table gives an empty one.
    """
    docs = docs.drop(*ADDED)
    parts = docs.sparkSession.sparkContext.broadcast((model.index, model.emit, model.move))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_assign long, n_access long, n_hex long, base_spans string, secret_spans array<struct<kind:string,start:long,end:long>>"])
    return docs.mapInArrow(_scanned(parts, docs.columns, text_col), schema)


def redacted(text, spans, mark: str = "[SECRET]"):
    """The text with each span replaced; overlapping spans become one mark."""
    zero = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["done"].alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
        F.struct(F.concat(acc["done"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("done"), s["end"].alias("at"))
    )
    made = F.aggregate(spans, zero, step)
    return F.when(F.size(spans) > 0, F.concat(made["done"], F.substring(text, made["at"].cast("int") + 1, 2**31 - 1 - 16))).otherwise(text)
