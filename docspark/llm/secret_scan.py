"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Base spans come from the three patterns below and stay. The field tags every token of a text (a run of the characters
that secrets consist of) as beginning a secret, inside one or outside. Features are the token's shape (length, kinds of
characters, shares of digits, vowels and changes between kinds), what stands before and after it, the shapes of the
tokens beside it, how far back a secret's name stands, and properties of the whole file. Viterbi finds the best tags of
the whole chain: it is run over the stretches that could hold a tag other than O, and a bound on what any other stretch
can gain shows that the rest is O (Field.decode). The spans that it tags have kind "field", whether a base span covers
them or not, so the result shows what each of the two finds; n_new counts those that overlap no base span.

The field is fitted to the labelled lines of labelled_lines() (secrets in forms that the patterns miss: prose, URL
credentials, bearer tokens, key blocks of several lines, codes in groups; and look-alikes) and to at most SAMPLE_CHUNKS
stretches of about CHUNK tokens of some SAMPLE_DOCS documents, chosen by hash, whose tokens the base spans label
(stretches with a name or a run that may be a secret, but no base span, are left out: they would teach that it is none).

A null or empty text has no spans. Places are code points, ends exclusive. Rows are independent: ties, repeated rows
and ids change nothing. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import written

SAMPLE_DOCS = 40_000
SAMPLE_CHUNKS = 4000
CHUNK = 16
STEPS = 120
#: Characters of texts that are tagged by one set of array operations.
AT_ONCE = 4_000_000
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_KINDS = {"assign": 0, "access": 1, "hex": 2, "field": 3}
#: What may announce a secret, and what begins a block of key lines.
_NAME = re.compile(r"(BEGIN [A-Z ]*PRIVATE KEY)|pass(?:word|wd|phrase|code)?\b|pwd|secret|token|(?:api|access|private|signing)[ _-]?key|bearer|credentials?|(?:recovery|backup) codes?", re.I | re.A)
#: What may be a secret that the base patterns miss: a sampled stretch with one of these teaches nothing, unless a base span is in it.
_UNSURE = re.compile(rf"{_NAME.pattern}|://[^\s/]*:[^\s/]*@|(?=[a-z0-9+/_-]*[0-9])(?=[a-z0-9+/_-]*[a-z])[a-z0-9+/_-]{{20}}", re.I | re.A)
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans by start, then kind."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    found: list[Span] = []
    if any(w in raw for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"akia" in raw:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of [0-9a-f] is matched whole or not at all, so 24 or more can be asked for at once
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _KINDS[s[0]]))


#: Of each ASCII character: 1 lower case, 2 upper case, 4 digit, 8 other sign of a token; 0 stands between tokens.
_CLASS = np.zeros(129, np.uint8)
for _chars, _bit in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 4), ("+/_.-", 8)):
    _CLASS[[ord(c) for c in _chars]] = _bit
_HEXED, _VOWEL, _GAP = np.zeros(129, bool), np.zeros(129, bool), np.zeros(129, np.uint8)
_HEXED[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
#: What a character between tokens is: 1 blank, 2 line end, 3 quote, 4 : or =, 5 @, 6 other ASCII, 7 not ASCII.
_GAP[:] = 6
for _chars, _kind in ((" \t", 1), ("\n\r", 2), ("\"'`", 3), (":=", 4), ("@", 5)):
    _GAP[[ord(c) for c in _chars]] = _kind
_GAP[128] = 7
_LENGTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64])

#: Features of a token and how many values each has.
SIZES = {
    "length": 18, "kinds": 16, "digits": 9, "changes": 9, "vowels": 9, "hex,length": 36, "kinds,length": 288,
    "before": 64, "after": 8, "kinds before": 17, "kinds after": 17, "length before": 19, "length after": 19,
    "name": 18, "name,length": 324, "name,before": 144, "file size": 32, "file names": 2, "any": 1,
}
_OFFSETS = dict(zip(SIZES, np.cumsum([0, *SIZES.values()])[:-1].tolist(), strict=True))
WIDTH = sum(SIZES.values())


class Tokens:
    """The tokens of texts: text (which one), start, end (places in it) and features (one row of feature numbers each)."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        # two line ends between texts, so that no token and no gap goes across
        joined = "\n\n".join(texts) + "\n\n"
        codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), 128)
        begins = np.cumsum(sizes + 2) - sizes - 2
        kind = _CLASS[codes]
        edge = np.flatnonzero(np.diff(kind > 0, prepend=False))
        start, end = edge[0::2], edge[1::2]
        self.text = np.searchsorted(begins, start, side="right") - 1
        self.start, self.end, self.n = start - begins[self.text], end - begins[self.text], len(start)
        self.features = self._features(texts, joined, codes, kind, start, end, sizes, begins)

    def _features(self, texts, joined, codes, kind, start, end, sizes, begins) -> np.ndarray:
        out = np.empty((self.n, len(SIZES)), np.int32)
        if not self.n:
            return out
        n = end - start
        total = lambda hit: np.add.reduceat(hit, np.column_stack((start, end)).ravel(), dtype=np.int64)[::2]
        lower, upper, digits = (total(kind == bit) for bit in (1, 2, 4))
        kinds = (lower > 0) + 2 * (upper > 0) + 4 * (digits > 0) + 8 * (n > lower + upper + digits)
        length = np.searchsorted(_LENGTHS, n, side="right") - 1
        turn = np.append(kind[1:] != kind[:-1], False)
        turn[end - 1] = False
        first = np.append(True, self.text[1:] != self.text[:-1])
        last = np.append(first[1:], True)
        shifted = lambda x, none: (np.where(first, none, np.roll(x, 1)), np.where(last, none, np.roll(x, -1)))
        gap = _GAP[codes]
        # the two characters before a token: 0 where the text begins
        near = np.where(self.start > 0, gap[start - 1], 0)
        far = np.where(self.start > 1, gap[start - 2] * (kind[start - 2] == 0), 0)
        before = near * 8 + far
        named, names = self._named(joined, start)
        with_names = np.zeros(len(texts), bool)
        with_names[np.unique(np.searchsorted(begins, names, side="right") - 1)] = len(names) > 0
        columns = {
            "length": length, "kinds": kinds, "digits": 8 * digits // n, "changes": 8 * total(turn) // n, "vowels": 8 * total(_VOWEL[codes]) // n,
            "hex,length": 18 * (total(_HEXED[codes]) == n) + length, "kinds,length": 18 * kinds + length, "before": before, "after": np.where(end - begins[self.text] < sizes[self.text], gap[np.minimum(end, len(gap) - 1)], 0),
            "kinds before": shifted(kinds, 16)[0], "kinds after": shifted(kinds, 16)[1], "length before": shifted(length, 18)[0], "length after": shifted(length, 18)[1],
            "name": named, "name,length": 18 * named + length, "name,before": 8 * named + near, "file size": np.minimum(31, np.log2(sizes[self.text] + 1).astype(int)), "file names": with_names[self.text], "any": np.zeros(self.n, int),
        }
        for k, (name, column) in enumerate(columns.items()):
            out[:, k] = column.astype(np.int64) + _OFFSETS[name]
        return out

    def _named(self, joined: str, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens since the last name ended (1 to 8; 9 to 16 after the head of a key block; 17: part of a name; 0: none) and where names are."""
        out, at = np.zeros(self.n, np.int64), []
        for m in _NAME.finditer(joined):
            at.append(m.start())
            a, b = np.searchsorted(start, (m.start(), m.end()))
            inside = slice(max(0, a - 1) if a and start[a - 1] + (self.end - self.start)[a - 1] > m.start() else a, b)
            reach = np.arange(b, min(b + 8, self.n))
            reach = reach[self.text[reach] == self.text[max(0, b - 1)]]
            out[reach] = reach - b + (9 if m[1] else 1)
            out[inside] = 17
        return out, np.array(at, np.int64)


class Field:
    """The linear-chain field: weights of (feature, state) and of (state, state); states O, B, I."""

    #: added to moves that can't be: I follows B or I
    BANNED = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]])

    def __init__(self, state: np.ndarray | None = None, move: np.ndarray | None = None):
        self.state = np.zeros((WIDTH, 3)) if state is None else state
        self.move = np.zeros((3, 3)) if move is None else move

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for k in range(features.shape[1]):
            out += self.state[features[:, k]]
        return out

    def viterbi(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best tags of chains (scores, padded to one length; sizes) that stand between O tokens or text ends."""
        move, (n, long) = self.move + self.BANNED, at.shape[:2]
        back = np.empty((long, n, 3), np.int8)
        best = at[:, 0] + move[0]
        for i in range(1, long):
            ways = best[:, :, None] + move
            within = (i < sizes)[:, None]
            back[i] = np.where(within, ways.argmax(axis=1), [0, 1, 2])
            best = np.where(within, ways.max(axis=1) + at[:, i], best)
        tags = np.empty((n, long), np.int8)
        tags[:, -1] = (best + move[:, 0]).argmax(axis=1)
        for i in range(long - 1, 0, -1):
            tags[:, i - 1] = back[i, np.arange(n), tags[:, i]]
        return tags

    def decode(self, text: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The best tags of each text's whole chain.

        Let r be the range of the moves' weights and a token's gain its best score above O plus 2 r. A stretch of B and I
        of g tokens has g + 1 moves that gain at most r each over O-O, so it is worth nothing if no token of it has a
        positive gain (it is hot), and a stretch's end after its last hot token is worth nothing either. Tokens
        between hot ones, and those before the first, may be tagged only if what they lose is less than a new
        beginning costs: four moves, and B instead of I. So stretches are decoded apart where more is lost.
        """
        tags = np.zeros(len(text), np.int8)
        if not len(text):
            return tags
        at = self.scores(features)
        above = at[:, 1:] - at[:, :1]
        moves = np.delete(self.move.ravel(), 2)
        reach = float(moves.max() - moves.min())
        gain = above.max(axis=1) + 2 * reach
        hot = np.flatnonzero(gain > 0)
        if not len(hot):
            return tags
        lost = np.append(0, np.cumsum(np.minimum(gain, 0)))
        anew = 8 * reach + max(0.0, float((above[hot, 1] - above[hot, 0]).max()))
        apart = (text[hot[1:]] != text[hot[:-1]]) | (lost[hot[1:]] - lost[hot[:-1] + 1] < -anew)
        firsts, lasts = hot[np.append(True, apart)], hot[np.append(apart, True)]
        # back to where more is lost than a beginning costs, or the text begins
        lead = np.searchsorted(-lost, -lost[firsts] - anew, side="left")
        firsts = np.maximum(np.minimum(lead, firsts), np.searchsorted(text, text[firsts]))
        sizes = lasts - firsts + 1
        for bits in np.unique(np.ceil(np.log2(sizes)).astype(int)).tolist():
            own = np.flatnonzero(np.ceil(np.log2(sizes)).astype(int) == bits)
            each = firsts[own, None] + np.arange(sizes[own].max())
            real = each <= lasts[own, None]
            got = self.viterbi(at[np.minimum(each, len(at) - 1)], sizes[own])
            tags[each[real]] = got[real]
        return tags

    def fit(self, chains: list[tuple[np.ndarray, np.ndarray]], rate: float = 0.15, pull: float = 0.01) -> Field:
        """Ascends the likelihood of the chains (features, tags), all at once, by Adam; the same data give the same field."""
        n, long = len(chains), max(len(t) for _, t in chains)
        feats = np.zeros((n, long, len(SIZES)), np.int64)
        tags = np.zeros((n, long), np.int64)
        real = np.zeros((n, long), bool)
        for k, (f, t) in enumerate(chains):
            feats[k, : len(t)], tags[k, : len(t)], real[k, : len(t)] = f, t, True
        flat, before = feats[real], np.concatenate((np.zeros((n, 1), np.int64), tags[:, :-1]), axis=1)
        ends = real.sum(axis=1) - 1
        seen = np.zeros((WIDTH, 3))
        for y in range(3):
            seen[:, y] = np.bincount(flat[tags[real] == y].ravel(), minlength=WIDTH)
        went = np.zeros((3, 3))
        np.add.at(went, (before[real], tags[real]), 1)
        np.add.at(went, (tags[np.arange(n), ends], 0), 1)
        first, second = [np.zeros_like(w) for w in (self.state, self.move)], [np.zeros_like(w) for w in (self.state, self.move)]
        for step in range(1, STEPS + 1):
            move = self.move + self.BANNED
            at = np.zeros((n, long, 3))
            at[real] = self.scores(flat)
            fore, rear = np.zeros((n, long, 3)), np.zeros((n, long, 3))
            fore[:, 0] = at[:, 0] + move[0]
            for i in range(1, long):
                fore[:, i] = np.where(real[:, i, None], np.logaddexp.reduce(fore[:, i - 1, :, None] + move, axis=1) + at[:, i], fore[:, i - 1])
            rear[:, -1] = move[:, 0]
            for i in range(long - 2, -1, -1):
                rear[:, i] = np.where(real[:, i + 1, None], np.logaddexp.reduce(move + (at[:, i + 1] + rear[:, i + 1])[:, None, :], axis=2), move[:, 0])
            whole = np.logaddexp.reduce(fore[np.arange(n), ends] + move[:, 0], axis=1)
            share = np.exp(fore + rear - whole[:, None, None])
            expected = np.zeros((WIDTH, 3))
            for y in range(3):
                expected[:, y] = np.bincount(flat.ravel(), np.repeat(share[real][:, y], flat.shape[1]), WIDTH)
            passed = np.zeros((3, 3))
            passed[0] += share[:, 0].sum(axis=0)
            passed[:, 0] += share[np.arange(n), ends].sum(axis=0)
            for i in range(1, long):
                both = fore[:, i - 1, :, None] + move + (at[:, i] + rear[:, i])[:, None, :] - whole[:, None, None]
                passed += np.exp(both)[real[:, i]].sum(axis=0)
            for k, (w, slope) in enumerate(((self.state, seen - expected - pull * self.state), (self.move, went - passed - pull * self.move))):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                w += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def labelled_lines(seed: int = 1, times: int = 12) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines, and the places of the secrets in them: forms with {made-up secrets} and look-alikes without."""
    rng = random.Random(seed)
    letters, capitals, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    run = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    make = {
        "w": lambda: run(letters, rng.randrange(2, 6)) + run(digits, rng.randrange(1, 4)) + run(letters + digits + capitals, rng.randrange(2, 8)),
        "p": lambda: "".join(rng.choice("correct horse battery staple winter summer dragon monkey river stone".split()) for _ in range(rng.randrange(2, 4))),
        "k": lambda: run(letters + capitals + digits, rng.choice((20, 24, 32, 36, 40))),
        "x": lambda: run("0123456789abcdef", rng.choice((16, 20, 32, 40, 64))),
        "b": lambda: run(letters + capitals + digits + "+/", 64),
        "s": lambda: rng.choice(("sk_live_", "ghp_", "xoxb-", "glpat-")) + run(letters + capitals + digits, rng.choice((20, 24, 36))),
        "g": lambda: " ".join(run(letters, 4) for _ in range(4)),
        "c": lambda: "-".join(run(capitals + digits, 5) for _ in range(5)),
        "j": lambda: ".".join("ey" + run(letters + capitals + digits + "_-", rng.randrange(20, 60)) for _ in range(3)),
    }
    secret = [
        "the password is {w} for all of us", "her password was {p} until May", "pwd {w}", "use the passphrase {p} to open it", "login anna and password {w} please", "passcode: {w}",
        "Authorization: Bearer {j}", "bearer {k}", "https://anna:{w}@db.example.org/main", "postgres://app:{k}@10.0.0.7:5432/x", "api key {k}", "the access key {k} must not leave the house",
        "our token is: {x} here", "token was {k}", "secret {x}", "the secret {k} is in the file", "{s}", "use {s} for it", "client credential {k}", "signing key -> {x}",
        "-----BEGIN RSA PRIVATE KEY-----\n{b\nb\nb}\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\n{b\nb}\n-----END PRIVATE KEY-----", "app password {g} for mail", "recovery code {c}", "backup codes {c}", "private key {b}",
    ]
    plain = [
        "we met on 2024-03-17 at 10:45 in room 1204", "call +49 30 1234567 or 030-765432 today", "see https://www.example.com/a/b/page-12.html for more", "ISBN 978-3-16-148410-0 is out", "order 20240317-00042 was sent", "host 192.168.10.24 answers", "write to anna.smith84@mail2.example.com",
        "please change your password before Monday", "the password must be long", "a token ring network of 1987", "he kept the secret for years", "secret gardens of the north", "the key to the house", "passing the bearer of news", "no token was sent to them", "the api key page of the manual",
        "version 3.10.4-rc1 of libfoo_bar.so.12", "internationalization and characteristically", "in 1999 there were 12,345,678 of them", "IBAN DE89370400440532013000 for rent", "4785380592391139 and more", "The quick brown fox jumps over a lazy dog", "path /usr/local/share/doc/readme.txt", "it costs $3,499.00 or 12.5 %", "credentials of the new teacher", "the recovery code was never used",
    ]
    out: list[tuple[str, list[tuple[int, int]]]] = []
    for form in secret * times:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{([a-z\n]+)\}", form):
            text += form[at : m.start()]
            made = "\n".join(make[c]() for c in m[1].split("\n"))
            spans.append((len(text), len(text) + len(made)))
            text, at = text + made, m.end()
        out.append((text + form[at:], spans))
    for form in plain * times:
        out.append((re.sub(r"(?<=\d)\d|\d(?=\d)", lambda _: rng.choice(digits), form), []))
    # the same in the middle of other words
    words = "of the and it was by them when we saw a new one there with all that".split()
    few = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(6)))
    rows = []
    for text, spans in out:
        lead = few()
        lead += " " if lead else ""
        rows.append((f"{lead}{text} {few()}".rstrip(), [(a + len(lead), b + len(lead)) for a, b in spans]))
    return rows


def _tags(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Each token's tag: B for the first that overlaps a span, I for those after it."""
    tags = np.zeros(tokens.n, np.int8)
    bounds = np.searchsorted(tokens.text, np.arange(len(spans) + 1))
    for k, own in enumerate(spans):
        lo, hi = int(bounds[k]), int(bounds[k + 1])
        for a, b in own:
            i = lo + int(np.searchsorted(tokens.end[lo:hi], a, side="right"))
            j = lo + int(np.searchsorted(tokens.start[lo:hi], b, side="left"))
            if i < j:
                tags[i], tags[i + 1 : j] = 1, 2
    return tags


def _values(text: str) -> list[tuple[int, int]]:
    """What the base spans mark as secret: of an assignment, the value alone."""
    found = [m.span(2) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return found + [(a, b) for kind, a, b in base_spans(text) if kind != "assign" and not any(x < b and a < y for x, y in found)]


def _sampled(docs: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """At most SAMPLE_CHUNKS stretches of at most SAMPLE_DOCS documents or so, with their tags: half of them with a base
    span, if there are so many. Documents and stretches are chosen by hashes of their texts, so that neither the table's
    layout nor its order matters."""
    rows = docs.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                values = _values(text)
                # of each text, one stretch taken by its hash, and those about its base spans
                places = {_hash(text) % (len(text) // 6 // CHUNK + 1) * 6 * CHUNK} | {max(0, a - 40) for a, _ in values}
                for place in places:
                    # whole tokens: a stretch begins and ends between blanks
                    a = text.rfind(" ", 0, place) + 1
                    b = text.find(" ", place + 6 * CHUNK)
                    part = text[a : b if b >= 0 else len(text)][:1000]
                    own = [(max(0, x - a), min(len(part), y - a)) for x, y in values if x - a < len(part) and y > a]
                    if own or not _UNSURE.search(part):
                        rows.append((bool(own), _hash(part), part, ",".join(f"{x}:{y}" for x, y in own)))
            yield pd.DataFrame(rows, columns=["hit", "k", "part", "spans"]).astype({"hit": "bool", "k": "int64"})

    drawn = docs.where("length(text) > 0").where(F.pmod(F.xxhash64("text"), F.lit(10**6)) <= 10**6 * min(1.0, SAMPLE_DOCS / max(1, rows)))
    found = drawn.select("text").mapInPandas(run, "hit boolean, k long, part string, spans string").dropDuplicates(["k", "part"])
    found = written(found, "stretches")
    got = [r for hit in ("hit", "NOT hit") for r in found.where(hit).orderBy("k", "part").limit(SAMPLE_CHUNKS // 2).collect()]
    spans = [[(int(x), int(y)) for x, y in (s.split(":") for s in r.spans.split(",") if s)] for r in got]
    return _chains(Tokens([r.part for r in got]), spans)


def _hash(part: str) -> int:
    return int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


def _chains(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The texts' chains, cut to 3 * CHUNK tokens about their first secret."""
    tags, out = _tags(tokens, spans), []
    bounds = np.searchsorted(tokens.text, np.arange(len(spans) + 1)).tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a < b:
            hit = np.flatnonzero(tags[a:b])
            lo = max(a, a + int(hit[0]) - CHUNK) if len(hit) else a
            out.append((tokens.features[lo : min(b, lo + 3 * CHUNK)], tags[lo : min(b, lo + 3 * CHUNK)]))
    return out


@lru_cache(maxsize=1)
def _taught() -> list[tuple[np.ndarray, np.ndarray]]:
    lines = labelled_lines()
    return _chains(Tokens([t for t, _ in lines]), [s for _, s in lines])


def fit_field(docs: DataFrame) -> Field:
    """The field for docs (text): fitted to the labelled lines and to the sampled stretches."""
    return Field().fit(_taught() + _sampled(docs))


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """The spans that the field tags in each text."""
    tokens = Tokens(texts)
    tags = field.decode(tokens.text, tokens.features)
    out: list[list[Span]] = [[] for _ in texts]
    for i in np.flatnonzero(tags).tolist():
        own = out[tokens.text[i]]
        if tags[i] == 1:
            own.append(("field", int(tokens.start[i]), int(tokens.end[i])))
        else:
            own[-1] = ("field", own[-1][1], int(tokens.end[i]))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= AT_ONCE:
            yield part
            part, chars = [], 0
    yield part


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_field, n_new for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    field = fit_field(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for part in _parts(batch["text"].tolist()):
                for text, more in zip(part, field_spans(part, field), strict=True):
                    base = base_spans(text)
                    kinds = [k for k, _, _ in base]
                    both = sorted(base + more, key=lambda s: (s[1], _KINDS[s[0]]))
                    new = sum(all(b <= s[1] or s[2] <= a for s in base) for _, a, b in more)
                    rows.append((*(kinds.count(k) for k in ("assign", "access", "hex")), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both), len(more), new))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field", "n_new"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_field long, n_new long")
