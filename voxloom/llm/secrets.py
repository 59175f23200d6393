"""Secrets by fixed patterns and a linear-chain conditional random field.

The patterns give the base spans. The field tags the words of a text as begin, inside or outside of a secret, from each
word's shape, its two neighbours and the document's own make-up; every run on the best path that holds more than base spans
is a span too. It learns by maximum likelihood from two tables of windows: one drawn from the corpus, with the base spans
as labels, and a labelled one of secrets that no pattern shows (login addresses, bearer lines, key blocks, split
assignments, passwords in prose) beside what only looks like them (UUIDs, checksums in capitals, dates, codes, names).

Decoding is Viterbi's, exact but short: where a word's lead for "outside" exceeds all that the two moves around it can
change, every best path passes "outside" there, and only the words between such points need a table. Texts stay where
they lie; no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices, words

#: Bounds of the sample to learn from: different documents, and of each the windows around base spans, around other odd
#: words, and around any words; words on each side of a window's middle.
SAMPLE, OF_SPANS, OF_ODD, OF_ANY, REACH = 3_000, 6, 2, 1, 4
#: Lines of the labelled table.
LABELLED = 1_500
STEPS, RATE, DECAY = 80, 0.2, 1e-3

#: The base patterns, in the order that spans of one start take.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_KEYWORD = re.compile(r"pass(?:word|wd|phrase)?$|secret|token|api|key$|credential|auth|pwd|bearer|login", re.I)
_KEYED = "(?i)pass|pwd|secret|token|api|key|credential|auth|bearer|login"  # finds all that _KEYWORD finds
_LOGIN = re.compile(r"://[^/\s:@]+:[^/\s@]{4,}@")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Marks around a word that are no part of it.
_MARKS = "\"'`.,;:!?()[]{}<>*#$%&|~^\\"
#: Words of letters between such marks; their features come from length, case and marks alone.
_PLAIN = r"^(?:\pL\p{Ll}{0,23}|\p{Lu}{2,24})$"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in the order of the digest."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))


OWN = (
    "bias long8 long12 long16 long20 long32 lower upper digit only_digits half_digits mixed_case digit_and_lower digit_and_upper upper_digits hex16 "
    "turns4 turns8 even_mix assigned quoted dotted at_sign plus_slash dashes value keyword symbols other_letters login uuid capital_hex mixed_mark slashes"
).split()
NEAR = "keyword equals ends_assign quoted_value none block".split()
FILE = "many_digits keyword_somewhere short code_like".split()
WIDTH = len(OWN) + 2 * len(NEAR) + len(FILE)


def own_features(word: str) -> np.ndarray:
    core = word.strip(_MARKS)
    tail = re.split(r"[:=]", core)[-1] if re.search(r"[A-Za-z0-9][:=]", core) else core
    n = len(tail)
    digits, lower, upper = (sum(map(f, tail)) for f in (str.isdigit, str.islower, str.isupper))
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "x" for c in tail]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    entropy = -sum(v / n * math.log2(v / n) for v in Counter(tail).values()) if n >= 10 and digits else 0
    return np.array(
        [
            1, n >= 8, n >= 12, n >= 16, n >= 20, n >= 32, lower > 0, upper > 0, digits > 0, digits == n > 0, n > 0 and 2 * digits >= n, lower > 0 and upper > 1,
            digits > 1 and lower > 0, digits > 1 and upper > 1, digits > 0 and digits + upper == n > 8, n >= 16 and 0 < digits < n and re.fullmatch("[0-9a-f]+", tail) is not None,
            turns >= 4, turns >= 8, n >= 10 and digits > 0 and entropy > 0.8 * math.log2(min(n, 40)), tail != core, word[:1] in "\"'`" and n >= 6, "." in tail, "@" in word, "+" in tail or "/" in tail, "-" in tail or "_" in tail,
            bool(_VALUE.search(tail)), bool(_KEYWORD.search(core.split("=")[0].split(":")[0])), sum(not c.isalnum() for c in word) > 2, any(c.isalpha() and c > "\x7f" for c in tail),
            bool(_LOGIN.search(word)), bool(_UUID.search(word)), n >= 16 and re.fullmatch("[0-9A-F]+", tail) is not None, digits > 0 and lower > 0 and upper > 0 and kinds.count("x") > 0 and "/" not in tail, tail.count("/") > 1,
        ],
        np.float32,
    )


def near_features(word: str) -> np.ndarray:
    core = word.strip(_MARKS.replace(":", ""))
    return np.array([bool(_KEYWORD.search(core.rstrip(":="))), core in ("=", ":", ":=", "=>"), core[-1:] in ("=", ":"), word[:1] in "\"'`" and len(core) >= 6, 0, "-----" in word], np.float32)


#: Neighbours beyond a text's ends.
EDGE = np.array([0, 0, 0, 0, 1, 0], np.float32)


@dataclass
class Slice:
    """Features of all words of some texts, by distinct word, and of each text."""

    codes: np.ndarray
    tokens: list[str]
    starts: np.ndarray
    own: np.ndarray
    near: np.ndarray
    file: np.ndarray
    may: np.ndarray  # distinct words that a base pattern could begin in

    @classmethod
    def of(cls, texts: pa.Array) -> Slice:
        codes, tokens, starts = words(texts)
        column = pa.array(tokens, pa.string())
        core = pc.utf8_trim(column, _MARKS)
        flag = lambda x: x.to_numpy(zero_copy_only=False)
        plain = flag(pc.match_substring_regex(core, _PLAIN))
        keyed = flag(pc.match_substring_regex(core, _KEYED))
        size, inner = flag(pc.utf8_length(column)), flag(pc.utf8_length(core))
        capital, accent = flag(pc.not_equal(pc.utf8_lower(core), core)), flag(pc.binary_length(core)) > inner
        shout = capital & flag(pc.equal(pc.utf8_upper(core), core)) & (inner > 1)
        quoted = flag(pc.match_substring_regex(column, "^[\"'`]"))
        own, near = np.zeros((len(tokens), len(OWN)), np.float32), np.zeros((len(tokens), len(NEAR)), np.float32)
        # The plain words fall into a few cases: one word of each is looked at.
        odd = ~plain | keyed
        case = np.where(odd, -1, inner * 32 + (size - inner > 2) * 16 + quoted * 8 + capital * 4 + shout * 2 + accent)
        for c in np.unique(case[~odd]):
            at = np.flatnonzero(case == c)
            own[at], near[at] = own_features(tokens[at[0]]), near_features(tokens[at[0]])
        for i in np.flatnonzero(odd):
            own[i], near[i] = own_features(tokens[i]), near_features(tokens[i])
        n = np.maximum(np.diff(starts), 1)
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[codes])])[starts])
        digit, keyword = own[:, OWN.index("digit")], own[:, OWN.index("keyword")]
        code_like = flag(pc.match_substring(pc.fill_null(texts, ""), ";\n"))
        file = np.stack([sums(digit) > 0.1 * n, sums(keyword) > 0, n < 50, code_like], axis=1).astype(np.float32)
        return cls(codes, tokens, starts, own, near, file, keyed | (inner >= 20))

    def at(self, i: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Features of the words i of texts `text`."""
        before, after = i > self.starts[text], i < self.starts[text + 1] - 1
        left = np.where(before[:, None], self.near[self.codes[np.maximum(i - 1, 0)]], EDGE)
        right = np.where(after[:, None], self.near[self.codes[np.minimum(i + 1, len(self.codes) - 1)]], EDGE)
        return np.concatenate([self.own[self.codes[i]], left, right, self.file[text]], axis=1)

    def positions(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in _WORD.finditer(text)]


OUTSIDE, BEGIN, INSIDE = range(3)


def tags(positions: list[tuple[int, int]], spans: list[tuple[int, str, int]]) -> np.ndarray:
    """Tags of the words that base spans touch."""
    out = np.zeros(len(positions), np.int8)
    for a, _, b in spans:
        first = True
        for i, (x, y) in enumerate(positions):
            if x < b and y > a:
                out[i] = INSIDE if not first or out[i] == INSIDE else BEGIN
                first = False
            elif x >= b:
                break
    return out


@dataclass
class Field:
    weights: np.ndarray  # features by tag
    moves: np.ndarray  # from tag to tag

    def emissions(self, s: Slice) -> np.ndarray:
        """By word and tag, without gathering features word by word."""
        a, b = len(OWN), len(OWN) + len(NEAR)
        c = b + len(NEAR)
        out = (s.own @ self.weights[:a])[s.codes]
        left, right = s.near @ self.weights[a:b], s.near @ self.weights[b:c]
        edge_left, edge_right = EDGE @ self.weights[a:b], EDGE @ self.weights[b:c]
        before, after = left[np.roll(s.codes, 1)], right[np.roll(s.codes, -1)]
        full = np.flatnonzero(np.diff(s.starts) > 0)
        before[s.starts[full]], after[s.starts[full + 1] - 1] = edge_left, edge_right
        return out + before + after + np.repeat(s.file @ self.weights[c:], np.diff(s.starts), axis=0)

    def secrets(self, e: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first word, last word + 1) of the tagged runs on the best path of each text."""
        t = self.moves
        # What "outside" in place of tag k can cost at most in the two moves around it.
        slack = [-min(0, (t[:, OUTSIDE] - t[:, k]).min()) - min(0, (t[OUTSIDE] - t[k]).min()) for k in (BEGIN, INSIDE)]
        open_ = np.flatnonzero((e[:, OUTSIDE] - e[:, BEGIN] <= slack[0]) | (e[:, OUTSIDE] - e[:, INSIDE] <= slack[1]))
        if not len(open_):
            return []
        text = np.searchsorted(starts, open_, "right") - 1
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(text) > 0)) + 1
        out = []
        for run, owner in zip(np.split(open_, cut), text[[0, *cut]]):
            a, b = int(run[0]), int(run[-1]) + 1
            path = self.viterbi(e[a:b], a > starts[owner], b < starts[owner + 1])
            k = 0
            while k < len(path):
                if path[k] == OUTSIDE:
                    k += 1
                    continue
                end = k + 1
                while end < len(path) and path[end] == INSIDE:
                    end += 1
                out.append((int(owner), a + k, a + end))
                k = end
        return out

    def viterbi(self, e: np.ndarray, outside_before: bool, outside_after: bool) -> np.ndarray:
        best = e[0] + (self.moves[OUTSIDE] if outside_before else 0)
        back = np.zeros(e.shape, np.int8)
        for k in range(1, len(e)):
            paths = best[:, None] + self.moves
            back[k] = paths.argmax(0)
            best = paths.max(0) + e[k]
        if outside_after:
            best = best + self.moves[:, OUTSIDE]
        path = np.zeros(len(e), np.int8)
        path[-1] = best.argmax()
        for k in range(len(e) - 1, 0, -1):
            path[k - 1] = back[k, path[k]]
        return path


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def likelihood(x: np.ndarray, y: np.ndarray, live: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log likelihood of the tags y of sequences x (padded at the end, live where not) and its gradients."""
    n, length, _ = x.shape
    e = x @ w
    alpha, beta = np.zeros((length, n, 3)), np.zeros((length, n, 3))
    alpha[0] = e[:, 0]
    for k in range(1, length):
        alpha[k] = np.where(live[:, k, None], _logsum(alpha[k - 1][:, :, None] + t, 1) + e[:, k], alpha[k - 1])
    total = _logsum(alpha[-1], 1)
    for k in range(length - 2, -1, -1):
        beta[k] = np.where(live[:, k + 1, None], _logsum(t + (e[:, k + 1] + beta[k + 1])[:, None, :], 2), 0)
    marginal = np.exp(alpha + beta - total[:, None]).transpose(1, 0, 2) * live[:, :, None]
    gold = np.eye(3)[y] * live[:, :, None]
    score = (gold * e).sum((1, 2))
    from_gold, from_model = np.zeros((3, 3)), np.zeros((3, 3))
    for k in range(1, length):
        on = live[:, k]
        np.add.at(from_gold, (y[on, k - 1], y[on, k]), 1)
        score[on] += t[y[on, k - 1], y[on, k]]
        from_model += np.exp(alpha[k - 1][on][:, :, None] + t + (e[on, k] + beta[k][on])[:, None, :] - total[on, None, None]).sum(0)
    return float((score - total).mean()), np.einsum("nlf,nlt->ft", x, gold - marginal) / n, (from_gold - from_model) / n


def fit(x: np.ndarray, y: np.ndarray, live: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adam."""
    w, t = np.zeros((x.shape[2], 3)), np.zeros((3, 3))
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, t)]
    for k in range(1, steps + 1):
        _, gw, gt = likelihood(x, y, live, w, t)
        for value, g, (m, v) in zip((w, t), (gw, gt), state):
            g = g - DECAY * value
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(w.astype(np.float32), t.astype(np.float32))


def labelled_lines(lines: int = LABELLED, seed: int = 1, positive: list[str] | None = None, negative: list[str] | None = None) -> list[tuple[str, list[tuple[int, int]]]]:
    """The labelled table, by rule: (text, spans of secrets). A line is a form of the lists below among ordinary words; half the lines hold a secret."""
    rng = random.Random(seed)
    text = lambda kinds, a, b: "".join(rng.choice(kinds) for _ in range(rng.randint(a, b)))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    values = {
        "key": lambda: text(lower + upper + digits, 20, 44),
        "long": lambda: text(lower + upper + digits + "+/", 48, 64) + rng.choice(["", "=", "=="]),
        "pass": lambda: text(lower, 2, 5) + text(upper, 1, 3) + rng.choice("$!#%&*?@^~") + text(digits, 1, 3) + text(lower + upper + digits + "$!#%^", 3, 8),
        "web": lambda: f"eyJ{text(lower + upper + digits, 14, 30)}.eyJ{text(lower + upper + digits, 20, 50)}.{text(lower + upper + digits + '_-', 24, 43)}",
        "dash": lambda: text(lower, 2, 4) + rng.choice("_-") + text(lower + upper + digits, 22, 40),
        "word": lambda: text(lower, 3, 9), "Word": lambda: text(lower, 3, 9).capitalize(), "num": lambda: text(digits, 1, 9), "CAPS": lambda: text(upper, 2, 8),
        "HASH": lambda: text(digits + "ABCDEF", 16, 40), "uuid": lambda: "-".join(text(digits + "abcdef", n, n) for n in (8, 4, 4, 4, 12)), "code": lambda: f"{text(upper, 1, 3)}{rng.choice('-/')}{text(digits, 2, 6)}",
    }
    out = []
    for k in range(lines):
        prose = lambda: [values[rng.choice(["word"] * 8 + ["Word", "num"])]() + rng.choice([""] * 8 + [",", "."]) for _ in range(rng.randint(3, 8))]
        form = rng.choice((SECRET_FORMS if positive is None else positive) if k % 2 else (PLAIN_FORMS if negative is None else negative))
        line, spans, at = " ".join(prose()) + " ", [], 0
        for part in re.split(r"(\{\w+\}|[«»])", form):
            if part == "«":
                at = len(line)
            elif part == "»":
                spans.append((at, len(line)))
            else:
                line += values[part[1:-1]]() if part[:1] == "{" and part[1:-1] in values else part
        out.append((line + " " + " ".join(prose()), spans))
    return out


#: The labelled forms: « and » hold a secret, braces name a kind of value.
SECRET_FORMS = [
    'Authorization: Bearer «{web}»', "Authorization: Bearer «{key}»", '"client_key": "«{key}»",', '"private_key" : "«{long}»"', "export PRIVATE_KEY=«{key}»", "set AUTH_KEY «{key}»",
    "passphrase: «{pass}»", "pwd=«{pass}»", "pwd is «{pass}»", "the login is {word} / «{pass}»", "use the passphrase «{pass}» to open it", "my pass «{pass}» still works", "login with «{pass}»",
    "«postgres://{word}:{pass}@{word}.example.net:5432/{word}»", "«https://{word}:{key}@{word}.example.org/{word}.git»", "«redis://{word}:{key}@10.0.0.7:6379»", "«mysql://{word}:{pass}@{word}/{word}»",
    "-----BEGIN PRIVATE KEY----- «{long} {long} {long}» -----END PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY----- «{long} {long}» -----END OPENSSH PRIVATE KEY-----",
    'key = "«{key}" \\ "{key}»"', 'credential = "«{key}» "', "credential -> «{key}»", "auth_key: «{dash}»", "X-Auth-Key: «{key}»", "«{dash}» is the auth key", "access key «{key}»", "signing key: '«{long}»'", "cookie auth=«{web}»",
]
PLAIN_FORMS = [
    "{uuid}", "id {uuid} was seen", "key {uuid}", "checksum {HASH} of the file", "SHA {HASH}", "the password was changed on 2024-03-0{num}", "a token of thanks", "the key to the {word}", "api of {word} and {word}", "secret {word} of the {word}",
    "auth failed for {word}", "login page", "order {code} of {num}", "model {code}{num}", "https://www.example.com/{word}/{word}?id={num}", "https://{word}.example.org/{Word}/{num}.html", "{word}.{num}@mail.example.com", "+49 30 {num}{num}",
    "{num}.{num}.{num}", "2023-11-{num}T10:22:31Z", "{Word}{Word}{Word}", "{word}_{word}_{num}.pdf", "{word}-{word}-{word}", "{CAPS}{num}", "{word}{num}", "$ {num},{num}", "{word}$$$ {word}%%% {word}!!", "{CAPS}! {CAPS}!!", "ISBN 978-{num}-{num}",
    "key: {word}", "keyword {Word}", "bearer of {word}", "credentials of {word}", "{word}/{word}/{word}", "def {word}_{word}({word}): return {word}", "<{word} class=\"{word}\">", "C{num}H{num}O{num}", "v{num}.{num}-rc{num}", "{word}|{word}|{num}",
]


def windows_of(texts: pa.Array, spans: list[list[tuple[int, str, int]]], wanted) -> Iterator[tuple[bytes, bytes]]:
    """Features and tags of the words around those that wanted(tags, first word, last word + 1, slice) names, for each text."""
    s, column = Slice.of(texts), texts.to_pylist()
    for k, text in enumerate(column):
        a, b = s.starts[k], s.starts[k + 1]
        tag = tags(s.positions(text), spans[k]) if spans[k] else np.zeros(b - a, np.int8)
        for middle in wanted(tag, a, b, s):
            at = np.arange(max(0, middle - REACH), min(b - a, middle + REACH + 1))
            yield s.at(a + at, np.full(len(at), k)).astype(np.float32).tobytes(), tag[at].tobytes()


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from the labelled table and at most `sample` different rows (doc_id, text), drawn by a hash of both."""
    rows = docs.where(F.length("text") > 0).withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)).withColumn("bits", F.length(F.bin("hash")))
    limit, total = 0, 0
    for r in sorted(rows.select("hash", "bits").distinct().groupBy("bits").agg(F.count("*").alias("n")).collect()):  # at most 63 rows
        total += r["n"]
        limit = r["bits"] if total <= sample else limit
    drawn = rows.where(F.col("bits") <= limit).groupBy("hash").agg(F.first("text").alias("text")).select("text")  # rows that repeat doc_id and text are one

    def some(which: np.ndarray, most: int) -> np.ndarray:
        """Places anywhere in a text, in the order of a hash."""
        return which[np.argsort(mixed(which.astype(np.uint64) + np.uint64(1)))[:most]]

    def wanted(tag: np.ndarray, a: int, b: int, s: Slice) -> list[int]:
        odd = s.own[:, OWN.index("value")] * (s.own[:, OWN.index("digit")] + s.own[:, OWN.index("mixed_case")]) + s.own[:, OWN.index("keyword")]
        outside = tag == OUTSIDE
        return [*some(np.flatnonzero(tag == BEGIN), OF_SPANS), *some(np.flatnonzero((odd[s.codes[a:b]] > 0) & outside), OF_ODD), *some(np.flatnonzero(outside), OF_ANY)]

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = list(windows_of(part.column("text"), [base_spans(x) for x in part.column("text").to_pylist()], wanted))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["x", "y"])

    found = [(r["x"], r["y"]) for r in drawn.mapInArrow(windows, "x binary, y binary").collect()]  # at most sample * (OF_SPANS + OF_ODD + OF_ANY)
    lines = labelled_lines()
    whole = lambda tag, a, b, s: [*np.flatnonzero(tag == BEGIN), *range(REACH, b - a, 2 * REACH + 1)]
    found += windows_of(pa.array([x for x, _ in lines]), [sorted({(a, "crf", b) for a, b in own} | {*base_spans(x)}) for x, own in lines], whole)
    length = 2 * REACH + 1
    x, y, live = np.zeros((len(found), length, WIDTH), np.float32), np.zeros((len(found), length), np.int64), np.zeros((len(found), length), bool)
    for k, (a, b) in enumerate(found):
        x[k, : len(b)], y[k, : len(b)], live[k, : len(b)] = np.frombuffer(a, np.float32).reshape(-1, WIDTH), np.frombuffer(b, np.int8), True
    return fit(x, y, live)


def _core(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without the marks around it."""
    while a < b and text[a] in "\"'`.,;:!?()[]{}<>":
        a += 1
    while b > a and text[b - 1] in "\"'`.,;:!?()[]{}<>":
        b -= 1
    return a, b


def scan(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """doc_id, secrets array<struct<kind, start, end, text>> of rows (doc_id, text): base spans, and those of the field that reach beyond them."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column("text")
                s = Slice.of(column)
                may = s.may
                text_of = np.repeat(np.arange(part.num_rows), np.diff(s.starts))
                tagged: dict[int, list[tuple[int, int]]] = {}
                for k, a, b in f.secrets(f.emissions(s), s.starts) if len(s.codes) else []:
                    tagged.setdefault(k, []).append((a - s.starts[k], b - s.starts[k]))
                out: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k in sorted({*np.unique(text_of[may[s.codes]]).tolist(), *tagged}):
                    text = column[k].as_py()
                    spans = base_spans(text)
                    if k in tagged:
                        places, base = s.positions(text), list(spans)
                        for a, b in tagged[k]:
                            x, y = _core(text, places[a][0], places[b - 1][1])
                            at = x
                            for p, _, q in base:  # in order of start
                                at = max(at, q) if p <= at else at
                            if any(c.isalnum() for c in text[at:y]):
                                spans.append((x, "crf", y))
                    out[k] = [{"kind": n, "start": a, "end": b, "text": text[a:b]} for a, n, b in sorted(spans, key=lambda z: (z[0], KINDS.index(z[1])))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], names=["doc_id", "secrets"])

    return docs.mapInArrow(find, "doc_id long, secrets array<struct<kind: string, start: long, end: long, text: string>>")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and its secrets.

    Null and empty texts have none. Rows that repeat doc_id and text each get a row. Texts of any length are read whole; of
    equally good paths that of the least tags is taken. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scan(rows, train(rows))


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of secrets() for comparison."""
    of = lambda *kinds: F.filter("secrets", lambda x: x["kind"].isin(*kinds))
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(join(of(*KINDS[:3])), 256).alias("base_sha256"), join(F.col("secrets")).alias("spans"))
