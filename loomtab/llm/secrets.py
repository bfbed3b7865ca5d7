"""Secret scans: base patterns and a linear-chain conditional random field.

The base patterns find assignments, access keys and long hexadecimal runs.  The field tags every
token of a text as outside a secret, or as its begin or inside, from the token's shape, the words
around it and features of the whole text, and adds what it tags to the base spans.

Its weights are fitted by maximum likelihood on windows out of a bounded sample of documents
(TRAIN_DOCS, by lowest hash of doc_id) tagged by the base patterns, and on SEEDS generated windows
with secrets of common shapes.  Decoding is exact Viterbi: a token whose outside score wins whatever
its neighbours are cuts the chain, so only the stretches between such tokens need the recursion.

Offsets are code points, end exclusive; a span of an assignment is the whole match.

Defined cases: null or empty text has no spans; rows are scanned one by one, repeated or not; an
empty table gives no rows; texts of any length are scanned whole; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

TRAIN_DOCS, SEEDS, WINDOW, STEPS = 1000, 800, 10, 80
REACH = 3
CHUNK_CHARS = 2_000_000
ROWS = 16_384  # distinct sets of features that are scored at a time

# The base patterns.
ASSIGN = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of all base spans, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def base_secrets(text: str) -> list[tuple[int, int]]:
    """Where the secret values of the base spans lie: what the field learns to tag."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(found + [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)])


# --- tokens and features ----------------------------------------------------------------------

_TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]")
_WORDS = {"pass", "password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "key", "auth", "bearer", "credential", "credentials"}
_VENDOR = re.compile("AKIA|gh[pousr]_|glpat-|xox[abprs]-|sk[-_]|pk_|eyJ|AIza")
_JOINTS = re.compile("[+/._-]")
SHORT_PIECE = 13
_HEXES = re.compile("[0-9a-f]+|[0-9A-F]+")

# Feature numbers: first those of the token itself, then of its surroundings, then of the text.
_SHAPE = ["len<4", "len<8", "len<16", "len<24", "len<40", "long", "digit", "upper", "lower", "mixed", "hex", "number", "joint", "changes3", "changes6", "many_kinds", "word", "mark", "short_pieces"]
_ROLE = ["keyword", "sign", "quote", "vendor", "at"]
_N_SHAPE, _N_ROLE = len(_SHAPE), len(_ROLE)
_BEFORE = ["prev_keyword", "prev2_keyword", "prev3_keyword", "prev_sign", "prev_quote", "next_quote", "next_sign", "prev_at", "next_at"]
_FILE = ["file_keyword", "file_signs"]
#: Neighbouring words, whatever they are, count by the bucket that their hash falls into.
BUCKETS = 11
_N_NEAR = _N_SHAPE + _N_ROLE + len(_BEFORE) + len(_FILE)
N = _N_NEAR + 2 * BUCKETS + 1
_WORD_AT = 58  # where a token's own bucket (from 1; 0: no word) is kept until its neighbours have it
B, I, O = 0, 1, 2


def token_bits(token: str) -> int:
    """Bit set of the token's own features."""
    n = len(token)
    bucket = (zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS + 1) << _WORD_AT if token.isalpha() and n > 1 else 0
    size = 0 if n < 4 else 1 if n < 8 else 2 if n < 16 else 3 if n < 24 else 4 if n < 40 else 5
    if token.isalpha() and (token.islower() or token.istitle()):  # most words: no changes worth a feature
        word = 1 << size | 1 << 8 | 1 << 16 | (not token.islower()) << 7
        return word | (token.lower() in _WORDS) << _N_SHAPE | bucket
    on = {size}
    digit, upper, lower = any(c.isdigit() for c in token), any(c.isupper() for c in token), any(c.islower() for c in token)
    on |= {k for k, x in ((6, digit), (7, upper), (8, lower), (9, digit and (upper or lower)), (11, token.isdigit())) if x}
    if n >= 8 and _HEXES.fullmatch(token) and digit:
        on.add(10)
    if any(c in "+/._-" for c in token):
        on.add(12)
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    if changes >= 3:
        on.add(13)
    if changes >= 6:
        on.add(14)
    if n >= 12 and len(set(token)) >= 10 and digit:
        on.add(15)
    if token.isalpha():
        on.add(16)
    if n == 1 and not token.isalnum():
        on.add(17)
    if 12 in on and max(map(len, _JOINTS.split(token))) < SHORT_PIECE:
        on.add(18)  # hosts, paths and versions
    base = _N_SHAPE
    if token.lower() in _WORDS or token.lower().endswith("_key"):
        on.add(base)
    if token in "=:":
        on.add(base + 1)
    if token in "\"'`":
        on.add(base + 2)
    if n >= 8 and _VENDOR.match(token):
        on.add(base + 3)
    if token == "@":
        on.add(base + 4)
    return sum(1 << k for k in on) | bucket


class Tokens:
    """Numbers tokens; keeps the bit sets of distinct ones in a bounded cache."""

    LIMIT = 500_000

    def __init__(self):
        self.bits: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bit sets of all tokens of all texts, their text, and tokens per text."""
        if len(self.bits) > self.LIMIT:
            self.bits.clear()
        own, counts = [], []
        for t in texts:
            found = _TOKEN.findall(t)
            known = list(map(self.bits.get, found))
            if None in known:
                self.bits.update((x, token_bits(x)) for x, b in zip(found, known) if b is None)
                known = list(map(self.bits.get, found))
            counts.append(len(found))
            own += known
        counts = np.array(counts, np.int64)
        return np.array(own, np.int64), np.repeat(np.arange(len(texts)), counts), counts


def full_bits(own: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bit sets with the surroundings and the features of the whole text."""
    key, sign, quote, _, ats = ((own >> (_N_SHAPE + k)) & 1 for k in range(5))

    def moved(flag: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(flag)
        if abs(by) >= len(flag):
            return out
        if by > 0:
            out[by:] = flag[:-by] * (doc[by:] == doc[:-by])
        else:
            out[:by] = flag[-by:] * (doc[:by] == doc[-by:])
        return out

    around = [moved(key, 1), moved(key, 2), moved(key, 3), moved(sign, 1), moved(quote, 1), moved(quote, -1), moved(sign, -1), moved(ats, 1), moved(ats, -1)]
    keys, signs = np.bincount(doc, key, len(counts)), np.bincount(doc, sign, len(counts))
    whole = [(keys > 0).astype(np.int64)[doc], (signs * 20 > counts).astype(np.int64)[doc]] if len(doc) else [own, own]
    out = own & ((1 << _WORD_AT) - 1)
    for k, flag in enumerate([*around, *whole], _N_SHAPE + _N_ROLE):
        out |= flag << k
    # the nearest word before and after, at most REACH tokens away
    bucket = own >> _WORD_AT
    for side, step in ((0, 1), (1, -1)):
        near = np.zeros_like(bucket)
        for by in range(1, REACH + 1):
            near = np.where(near == 0, moved(bucket, by * step), near)
        out |= np.where(near > 0, np.int64(1) << (_N_NEAR + side * BUCKETS + np.maximum(near, 1) - 1), 0)
    return out | (1 << (N - 1))


def as_matrix(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(N)) & 1).astype(np.float64)


# --- the field --------------------------------------------------------------------------------


class Field:
    """Weights (N, 3) of the state features and transitions (3, 3)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        # how much better than outside a tag may be through its neighbours at most
        best = np.full(2, -np.inf)
        for y in (B, I):
            for p in range(3):
                for n in range(3):
                    best[y] = max(best[y], moves[p, y] + moves[y, n] - moves[p, O] - moves[O, n])
        self.gain = best

    @classmethod
    def fit(cls, windows: list[tuple[np.ndarray, np.ndarray]]) -> Field:
        """Maximum likelihood with a quadratic penalty, by Adam on all windows at once."""
        length = max(len(b) for b, _ in windows)
        bits = np.zeros((len(windows), length), np.int64)
        tags = np.full((len(windows), length), O)
        mask = np.zeros((len(windows), length), bool)
        for i, (b, t) in enumerate(windows):
            bits[i, : len(b)], tags[i, : len(b)], mask[i, : len(b)] = b, t, True
        distinct, inverse = np.unique(bits, return_inverse=True)
        inverse = inverse.reshape(bits.shape)
        x = as_matrix(distinct)
        weights, moves = np.zeros((N, 3)), np.zeros((3, 3))
        told = np.eye(3)[tags] * mask[..., None]
        pair = mask[:, 1:] & mask[:, :-1]
        told_moves = np.einsum("bti,btj->ij", told[:, :-1] * pair[..., None], told[:, 1:])
        state = [np.zeros_like(v) for v in (weights, weights, moves, moves)]
        for step in range(1, STEPS + 1):
            e = (x @ weights)[inverse] * mask[..., None]
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, length):
                z = np.logaddexp.reduce(fwd[:, t - 1, :, None] + moves, axis=1) + e[:, t]
                fwd[:, t] = np.where(mask[:, t, None], z, fwd[:, t - 1])
            for t in range(length - 2, -1, -1):
                z = np.logaddexp.reduce(moves + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
                bwd[:, t] = np.where(mask[:, t + 1, None], z, bwd[:, t + 1])
            total = np.logaddexp.reduce(fwd[:, -1], axis=1)
            p = np.exp(fwd + bwd - total[:, None, None]) * mask[..., None]
            joint = fwd[:, :-1, :, None] + moves + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None]
            expected = (np.exp(joint) * pair[..., None, None]).sum((0, 1))
            slack = np.stack([np.bincount(inverse.reshape(-1), (told - p)[..., y].reshape(-1), len(distinct)) for y in range(3)], 1)
            grads = [x.T @ slack - 0.1 * weights, told_moves - expected - 0.1 * moves]
            for j, (v, g) in enumerate(zip((weights, moves), grads)):
                m, s = state[2 * j], state[2 * j + 1]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return cls(weights, moves)

    def tag(self, bits: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """Token ranges (first, end) that Viterbi tags as secrets; texts don't touch each other."""
        distinct, inverse = np.unique(bits, return_inverse=True)
        e = np.concatenate([as_matrix(distinct[a : a + ROWS]) @ self.weights for a in range(0, len(distinct), ROWS)] or [np.zeros((0, 3))])
        sure = ((e[:, :2] + self.gain) <= e[:, 2:]).all(1)
        open_at = np.flatnonzero(~sure[inverse])
        if not len(open_at):
            return []
        joint = (np.diff(open_at) == 1) & (doc[open_at[1:]] == doc[open_at[:-1]])
        spans: list[tuple[int, int]] = []
        for run in np.split(open_at, np.flatnonzero(~joint) + 1):
            score = e[inverse[run[0]]] + self.moves[O]
            back = []
            for t in run[1:]:
                step = score[:, None] + self.moves
                back.append(step.argmax(0))
                score = step.max(0) + e[inverse[t]]
            y = int((score + self.moves[:, O]).argmax())
            tags = [y]
            for b in reversed(back):
                y = int(b[y])
                tags.append(y)
            tags.reverse()
            first = None
            for t, y in zip(run.tolist(), tags):
                if first is not None and y != I:
                    spans.append((first, t))
                    first = None
                if y == B or y == I and first is None:
                    first = t
            if first is not None:
                spans.append((first, int(run[-1]) + 1))
        return spans


def tags_of(text: str, secrets: list[tuple[int, int]]) -> np.ndarray:
    """B, I, O per token: the tokens that overlap a secret."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    tags = np.full(len(spans), O)
    k = 0
    for i, (a, b) in enumerate(spans):
        while k < len(secrets) and secrets[k][1] <= a:
            k += 1
        if k < len(secrets) and secrets[k][0] < b:
            tags[i] = I if i and tags[i - 1] != O and spans[i - 1][1] > secrets[k][0] else B
    return tags


def seeds(count: int = SEEDS, seed: int = 5, shapes: tuple[int, ...] = (0, 1, 2, 3, 4, 5)) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated windows: secrets of common shapes behind their words, and what looks like them but isn't.

    ``shapes``: which of the kinds of secrets to generate; leaving some out tells whether they are found all the same.
    """
    rng = np.random.default_rng(seed)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    letters, alnum = string.ascii_lowercase, string.ascii_letters + string.digits
    plain = lambda: " ".join(pick(letters, rng.integers(2, 11)).capitalize() if rng.random() < 0.15 else pick(letters, rng.integers(2, 11)) for _ in range(rng.integers(3, 9)))
    secret = [
        lambda: pick("0123456789abcdef", rng.integers(24, 65)),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "sk-" + pick(alnum, rng.integers(24, 49)),
        lambda: pick(alnum + "+/", rng.integers(24, 65)),
        lambda: pick(alnum, rng.integers(10, 25)),
    ]
    decoy = [
        lambda: "+1 (%s) %s-%s" % (pick(string.digits, 3), pick(string.digits, 3), pick(string.digits, 4)),
        lambda: pick(string.digits, rng.integers(10, 17)),
        lambda: "https://%s.example.com/%s/%s?page=%s" % (pick(letters, 6), pick(letters, 2), pick(string.digits, 3), pick(string.digits, 1)),
        lambda: "%s@%s.example.com" % (pick(letters + string.digits, 6), pick(letters, 5)),
        lambda: "%s.%s@%s%s.%s.%s" % (pick(letters, 5), pick(letters, 6), pick(letters, rng.integers(3, 9)), pick(string.digits, rng.integers(0, 3)), pick(letters, rng.integers(4, 11)), rng.choice(["com", "org", "net", "de", "io"])),
        lambda: "https://%s%s.%s.%s/%s/%s-%s.html" % (pick(letters, 4), pick(string.digits, 2), pick(letters, 8), rng.choice(["com", "org", "fr"]), pick(letters, 5), pick(letters, 7), pick(string.digits, 4)),
        lambda: "/%s/%s/%s-%s.%s.%s.tar.gz" % (pick(letters, 3), pick(letters, 5), pick(letters, 6), *rng.integers(0, 30, 3)),
        lambda: "%s-%s.%s.%s.tar.gz" % (pick(letters, 6), *rng.integers(0, 30, 3)),
        lambda: "https://%s@%s.%s.org:%s/" % (pick(letters, 6), pick(letters, 6), pick(letters, 5), pick(string.digits, 4)),
        lambda: "v%s.%s.%s-%s%s" % (*rng.integers(0, 30, 3), rng.choice(["rc", "beta", "build"]), rng.integers(0, 99)),
        lambda: "%s_%s_%s" % (pick(letters, 5), pick(letters, 7), pick(string.digits, 3)),
        lambda: "%s-%s-%s" % (pick(string.digits, 4), pick("01", 2), pick(string.digits, 2)),
        lambda: "%s.%s.%s.%s" % tuple(rng.integers(0, 256, 4)),
        lambda: pick(letters, rng.integers(14, 26)),
        lambda: pick(string.ascii_uppercase, rng.integers(6, 20)),
        lambda: "%s### %s%%%%%% %s*** |" % (pick(letters, 5), pick(letters, 6), pick(letters, 4)),
        lambda: "key %s of the token" % pick(letters, 6),
    ]
    words = ["password", "secret", "token", "api_key", "access_key", "auth", "Bearer", "credential"]
    out = []
    for _ in range(count):
        before, after = plain() + " ", " " + plain()
        if rng.random() < 0.5:
            out.append((before + decoy[rng.integers(len(decoy))]() + after, []))
            continue
        value = secret[shapes[rng.integers(len(shapes))]]()
        if rng.random() < 0.1:  # a password in an address
            before, after = before + "%s://%s:" % (pick(letters, 5), pick(letters, 6)), "@%s.example.com/" % pick(letters, 3) + after
            out.append((before + value + after, [(len(before), len(before) + len(value))]))
            continue
        mark = rng.choice(['"', "'", ""])
        lead = "" if rng.random() < 0.2 and len(value) >= 24 else rng.choice(words) + rng.choice([" = ", ": ", "=", " ", " is "]) + mark
        start = len(before + lead)
        out.append((before + lead + value + mark + after, [(start, start + len(value))]))
    return out


def fit_field(docs: DataFrame, shapes: tuple[int, ...] = (0, 1, 2, 3, 4, 5)) -> Field:
    """The field of a corpus, from at most TRAIN_DOCS of its documents and the generated windows."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    # the rows are chosen by their keys, so that only the chosen texts go anywhere
    chosen = keyed.select("doc_id", "th").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(TRAIN_DOCS)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("id"), F.col("th").alias("of")))  # TRAIN_DOCS pairs of numbers
    met = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("of")))
    sample = met.groupBy("doc_id", "th").agg(F.first("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "th").select("text")
    number, windows = Tokens(), []

    def add(text: str, secrets: list[tuple[int, int]], all_of_it: bool) -> None:
        own, doc, counts = number([text])
        if not len(own):
            return
        bits, tags = full_bits(own, doc, counts), tags_of(text, secrets)
        if all_of_it:
            windows.append((bits[:40], tags[:40]))
            return
        # around every secret, around what has an odd shape, and the start of the text
        odd = np.flatnonzero((own >> 6) & 1 | (own >> 9) & 1 | (own >> 12) & 1)
        rare = odd[np.linspace(0, len(odd) - 1, min(3, len(odd))).astype(int)] if len(odd) else odd
        for at in {0, *rare.tolist(), *np.flatnonzero(tags == B).tolist()}:
            a, b = max(0, at - WINDOW), at + WINDOW
            windows.append((bits[a:b], tags[a:b]))

    for text, secrets in seeds(shapes=shapes):
        add(text, secrets, True)
    for row in sample.toLocalIterator():
        if row["text"]:
            add(row["text"], base_secrets(row["text"]), False)
    return Field.fit(windows)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans."""
    model = field or fit_field(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Tokens()
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            own, doc, counts = number(texts)
            extra: dict[int, list[tuple[int, int]]] = {}
            for first, end in model.tag(full_bits(own, doc, counts), doc):
                extra.setdefault(int(doc[first]), []).append((first, end))
            begin = np.cumsum(counts) - counts
            rows = []
            for i, text in enumerate(texts):
                base = base_spans(text)
                spans = base
                if i in extra:
                    at = [m.span() for m in _TOKEN.finditer(text)]
                    new = [(at[a - begin[i]][0], 3, at[b - begin[i] - 1][1]) for a, b in extra[i]]
                    spans = sorted(base + [s for s in new if all(s[2] <= x or s[0] >= y for x, _, y in base)])
                kinds = [k for _, k, _ in spans]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
