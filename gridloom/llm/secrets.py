"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags what they miss.

The field learns from windows around what the base patterns find, and from variants of them: other names for the key,
other ways to assign, values of other alphabets and lengths, no key at all; and from decoys that are no secrets. So it
tags by shape and context what the patterns' key words and alphabets don't list.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

# The base kinds, in their order.
_KEYWORD = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
BASE = {
    "assign": (re.compile(_KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}
_HEX_LONG = re.compile(r"[0-9a-f]{24}")
CRF = "crf"

#: What the field is fitted on, at most: documents (those first by a hash), windows of a document, windows in all, tokens of a window.
FIT_DOCS, FIT_OF_DOC, FIT_WINDOWS, FIT_TOKENS = 600, 16, 3000, 40
FIT_ROUNDS, RATE, RIDGE = 40, 0.5, 1e-4
#: Documents without a base secret that plain windows come from, at most, of each kind of text (PLAIN_KINDS); windows of each.
PLAIN_DOCS, PLAIN_OF_DOC = 120, 3
#: Share of the fitting documents whose windows are held out, to choose the margin that a span needs.
HELD_OUT = 5
#: A false span weighs as much as so many lost ones in that choice.
FALSE_COST = 5
O, B, I = 0, 1, 2
#: Spans of fewer characters are none.
LEAST = 6

_TOKEN = re.compile(r"[\w+/.\-]+(?:={1,2}(?!\w))?|[^\w\s]")
# Names of keys that a secret follows, and names that a plain value follows.
_SECRET_NAME = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|signing|encryption|license)[_-]?key|credential|bearer|(?:^|[_.\-])o?auth(?:$|[_.\-]|orization)")
_PLAIN_NAME = re.compile(r"user|login|name|mail|host|port|path|file|url|date|time|version|lang|color|colour|title|size|count|checksum|(?:^|[_.\-])(?:id|key)(?:$|[_.\-])")
#: What any of these names holds; most tokens hold none of it.
_ANY_NAME = re.compile("pass|pwd|secret|token|key|credential|bearer|auth|user|login|name|mail|host|port|path|file|url|date|time|version|lang|colo|title|size|count|checksum|id")
#: Documents worth fitting on hold one of these, in lower case.
_WORTH = ("password", "passwd", "secret", "token", "api_key", "apikey", "akia")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every base match, by start, then kind as listed."""
    found, low = [], text.lower()
    for kind, (rx, holds) in BASE.items():
        if kind == "assign" and not any(k in low for k in ("passw", "secret", "token", "api")):
            continue
        if kind == "hex" and not _HEX_LONG.search(text) or kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), m.end(), kind) for m in rx.finditer(text) if holds(m)]
    return sorted(found, key=lambda s: (s[0], [*BASE, CRF].index(s[2])))


def value_spans(text: str) -> list[tuple[int, int]]:
    """The secrets themselves: of an assignment its value, else the whole match."""
    found = []
    for kind, (rx, holds) in BASE.items():
        found += [m.span(2 if kind == "assign" else 0) for m in rx.finditer(text) if holds(m)]
    return sorted(found)


def shape(token: str) -> str:
    """What a token looks like: the kinds of its characters, its length and how evenly it uses them."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return "sym"
    length = f"{n // 4 if n < 24 else 6 + min(n, 64) // 16}{'v' * (len(set(token)) > 0.45 * min(n, 24))}"
    wide = "" if token.isascii() else "w"
    if token.isalpha() and (token.islower() or token.isupper()):
        return f"{'l' if token.islower() else 'U'}{wide}{length}"
    lower, upper, digit = any(map(str.islower, token)), any(map(str.isupper, token)), any(map(str.isdigit, token))
    other, only_hex = any(c in "+/_.=-" for c in token.rstrip(".")), digit and not set(token).difference("0123456789abcdef")
    return f"{'l' * lower}{'U' * upper}{'d' * digit}{'o' * other}{wide}{'x' * only_hex}{length}"


def word(token: str) -> str:
    """A token's name as context: symbols as they are, names of keys by their kind, any other word by nothing."""
    if len(token) == 1 and not token.isalnum():
        return token
    if len(token) > 40:
        return "-"
    t = token.lower()
    if not _ANY_NAME.search(t):
        return "-"
    t = t.strip("._-=")
    return "secret" if _SECRET_NAME.search(t) else "plain" if _PLAIN_NAME.search(t) else "-"


def flag_of(token: str, name: str) -> int:
    """A token's part in the file feature: 2 for the name of a secret, 1 for a mix of letters and digits."""
    return 2 * (name == "secret") + (len(token) > 8 and not token.isalpha() and any(map(str.isdigit, token)) and any(map(str.isalpha, token)))


def file_feature(tokens: list[str]) -> int:
    """0 to 3: does the text name secrets, and does it have tokens that mix letters and digits."""
    flags = [flag_of(t, word(t)) for t in tokens]
    return 2 * any(f & 2 for f in flags) + any(f & 1 for f in flags)


#: Feature templates: what of which neighbour. Positions beyond the text have the value '#'.
TEMPLATES = (("s", 0), ("w", 0), ("w", -1), ("w", -2), ("w", -3), ("s", -1), ("w", 1), ("s", 1))
PAD = 3


class Field:
    """Weights of a linear-chain conditional random field over O, B and I."""

    def __init__(self, weights: dict[tuple[str, int, str], np.ndarray], moves: np.ndarray, files: np.ndarray):
        self.weights, self.moves, self.files = weights, moves, files
        #: If O beats the others by more than this at a token, O is on the best path whatever the neighbours are.
        a = moves[:, :, None] + moves[None, :, :]  # [before, at, after] as before->at, at->after
        self.bound = float(max((a[p, y, q] - a[p, O, q]) for p in range(3) for q in range(3) for y in (B, I)))

        #: What the best path has to gain by a span for it to count.
        self.margin = 0.0

    def emissions(self, looks: list[tuple[str, str]]) -> np.ndarray:
        """[token, label] of a window: what its templates add up to."""
        at = lambda k, kind: "#" if not 0 <= k < len(looks) else looks[k][kind == "w"]
        zero = np.zeros(3)
        return np.array([sum((self.weights.get((kind, off, at(k + off, kind)), zero) for kind, off in TEMPLATES), zero) for k in range(len(looks))])

    def emissions_of(self, token: str) -> np.ndarray:
        """[template, label]: what the token adds at each place that looks at it."""
        s, w = shape(token), word(token)
        zero = np.zeros(3, np.float32)
        return np.stack([self.weights.get((kind, off, s if kind == "s" else w), zero) for kind, off in TEMPLATES]).astype(np.float32)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    best, back = scores[0], []
    for row in scores[1:]:
        all_ = best[:, None] + moves
        back.append(all_.argmax(0))
        best = all_.max(0) + row
    y = int(best.argmax())
    path = [y]
    for b in reversed(back):
        y = int(b[y])
        path.append(y)
    return path[::-1]


def looks_of(tokens: list[str]) -> list[tuple[str, str]]:
    """All that the field sees of tokens: shape and word."""
    return [(shape(t), word(t)) for t in tokens]


def fit(windows: list[tuple[list[tuple[str, str]], list[int], int]]) -> Field:
    """Maximum likelihood with a ridge, by full-batch AdaGrad; forward and backward sums over all windows at once.

    windows: looks of tokens, their labels, and the file feature."""
    index: dict[tuple[str, int, str], int] = {}
    length = max((len(t) for t, _, _ in windows), default=1)
    n = max(1, len(windows))
    feats = np.zeros((n, length, len(TEMPLATES)), np.int32)
    gold, mask, file_of = np.zeros((n, length), np.int64), np.zeros((n, length), bool), np.zeros(n, np.int64)
    index[("none", 0, "")] = 0
    for r, (looks, labels, kind) in enumerate(windows):
        file_of[r] = kind
        mask[r, : len(looks)] = True
        gold[r, : len(looks)] = labels
        for t in range(len(looks)):
            for k, (name, off) in enumerate(TEMPLATES):
                value = looks[t + off][name == "w"] if 0 <= t + off < len(looks) else "#"
                feats[r, t, k] = index.setdefault((name, off, value), len(index))
    weights, moves, files = np.zeros((len(index), 3)), np.zeros((3, 3)), np.zeros((4, 3))
    squares = [np.full_like(x, 1e-8) for x in (weights, moves, files)]
    onehot = np.eye(3)
    tokens_total = max(1, int(mask.sum()))
    flat = feats.reshape(-1)
    for _ in range(FIT_ROUNDS if windows else 0):
        e = weights[feats].sum(2) + files[file_of][:, None, :]
        psi, step = np.exp(e - e.max(2, keepdims=True)), np.exp(moves)
        alpha, beta = np.ones_like(e), np.ones_like(e)  # both scaled to sum to one at each token
        alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            a = (alpha[:, t - 1] @ step) * psi[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            b = (psi[:, t + 1] * beta[:, t + 1]) @ step.T
            beta[:, t] = np.where(mask[:, t + 1, None], b / b.sum(1, keepdims=True), 1)
        p = alpha * beta
        p *= mask[..., None] / p.sum(2, keepdims=True)
        gap = (onehot[gold] * mask[..., None] - p) / tokens_total
        g_w = np.stack([np.bincount(flat, np.repeat(gap[..., y].ravel(), len(TEMPLATES)), len(index)) for y in range(3)], 1)
        g_w[0] = 0
        g_f = np.stack([np.bincount(file_of, gap[..., y].sum(1), 4) for y in range(3)], 1)
        both = mask[:, 1:]
        ahead = (psi[:, 1:] * beta[:, 1:])[both]
        pair = alpha[:, :-1][both][:, :, None] * step * ahead[:, None, :]
        g_m = -(pair / pair.sum((1, 2), keepdims=True)).sum(0)
        np.add.at(g_m, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        g_m /= tokens_total
        for x, g, s in zip((weights, moves, files), (g_w, g_m, g_f), squares):
            g = g - RIDGE * x / 10
            s += g * g
            x += RATE * g / np.sqrt(s)
    return Field({k: weights[i].astype(np.float32) for k, i in index.items()}, moves, files.astype(np.float32))


def windows_of(text: str) -> list[tuple[list[str], list[int]]]:
    """Labelled windows of FIT_TOKENS tokens: those around the base's secrets, and the first one without any."""
    found = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    tokens = [t for t, _, _ in found]
    labels, spans, k = [O] * len(tokens), value_spans(text), 0
    for i, (_, a, b) in enumerate(found):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and b > spans[k][0]:
            labels[i] = I if i and labels[i - 1] != O and found[i - 1][2] > spans[k][0] else B
    out, plain = [], False
    for at in range(0, len(tokens), FIT_TOKENS):
        part = slice(at, at + FIT_TOKENS)
        if any(labels[part]) or not plain:
            plain |= not any(labels[part])
            out.append((tokens[part], labels[part]))
    return out


# What variants of windows are made of.
_NAMES = "pwd passphrase password passcode secret client_secret token access_token auth_token api_key apikey access_key private_key signing_key credential bearer db_password oauth authorization".split()
_DECOY_NAMES = "name user login host path file url date version lang color title size count id key".split()
_JOINTS = (["="], [":"], ["=", '"'], [":", '"'], ["=", "'"], [":", "'"], ["=", ">", '"'], ['"', ":", '"'], ["-", ">"])
_MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


STYLES = ("password", "mixed", "hex", "upper", "digits", "signed", "symbols", "lines", "bare")


def value(rng: random.Random, style: str) -> list[str]:
    """Tokens of a secret: a password, a key of mixed case, one in hexadecimal, in capitals, digits, a signed token, a password with symbols, lines of a key."""
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    if style == "password":
        return [draw("abcdefghijklmnopqrstuvwxyz", rng.randrange(4, 14)) + draw("0123456789", rng.randrange(1, 5))] if rng.random() < 0.5 else [draw(_MIXED, rng.randrange(8, 17)) + draw("0123456789", 2)]
    if style == "mixed":
        return [draw(_MIXED + rng.choice(["", "+/", "-_"]), rng.randrange(28, 72)) + rng.choice(["", "", "="])]
    if style == "hex":
        return [draw("0123456789abcdef", rng.choice([16, 20, 22, 32, 40, 64]))]
    if style == "upper":
        return [draw(rng.choice(["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]), rng.randrange(16, 65))]
    if style == "digits":
        return [draw("0123456789", rng.randrange(6, 13))]
    if style == "signed":
        return [".".join(["eyJ" + draw(_MIXED, rng.randrange(15, 60)), draw(_MIXED + "-_", rng.randrange(20, 90)), draw(_MIXED + "-_", rng.randrange(30, 60))])]
    if style == "symbols":
        return [x for k in range(rng.randrange(2, 4)) for x in ([rng.choice("!@#$%&*")] if k else []) + [draw(_MIXED, rng.randrange(2, 7))]]
    return [draw(_MIXED + "+/", 64) for _ in range(rng.randrange(2, 5))]


def decoy(rng: random.Random, plain: list[str]) -> list[str]:
    """Tokens that look like an assignment or a key and aren't secret."""
    some = lambda: rng.choice(plain)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([
        [rng.choice(_DECOY_NAMES), *rng.choice(_JOINTS), some()], [rng.choice(_DECOY_NAMES), *rng.choice(_JOINTS), digits(rng.randrange(1, 12))], [rng.choice(_DECOY_NAMES), "=", f"{digits(1)}.{digits(2)}.{digits(1)}"],
        [rng.choice(_NAMES), some(), some()], ["the", rng.choice(_NAMES), "of", some()], [rng.choice(_NAMES), ":", some()], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [digits(rng.choice([8, 10, 16]))],
        ["https", ":", "/", "/", f"www.{some()}.com/{some()}/{some()}-{some()}/{digits(4)}"], [f"{some()}.{digits(2)}", "@", f"{some()}.org"], [f"/usr/lib/{some()}/{some()}.py"],
        [some().capitalize() + some().capitalize() + some().capitalize()], [f"{some()}_{some()}_{some()}"], [some().upper()], ["#", digits(6)], [f"{some()}-{some()}-{some()}-{digits(2)}"],
    ])


def variants(tokens: list[str], labels: list[int], rng: random.Random) -> list[tuple[list[str], list[int]]]:
    """Windows in which the first secret has another name, joint or value, or no name; and one with decoys in their place."""
    plain = [t for t, y in zip(tokens, labels) if y == O and t.isalpha()] or ["word"]
    if B not in labels:
        at = rng.randrange(len(tokens) + 1)
        part = decoy(rng, plain)
        return [(tokens[:at] + part + tokens[at:], labels[:at] + [O] * len(part) + labels[at:])]
    i = labels.index(B)
    j = i + 1
    while j < len(labels) and labels[j] == I:
        j += 1
    start = next((k for k in range(max(0, i - 4), i) if word(tokens[k]) == "secret"), i)
    out = []
    for style in STYLES:
        joint = rng.choice([x for x in _JOINTS if style != "symbols" or x[-1] in "\"'"])
        if style == "bare":
            part, head = value(rng, "mixed"), [rng.choice(plain)] * (rng.random() < 0.5)
        elif style == "lines":
            part, head = value(rng, style), [*"-----", "BEGIN", rng.choice(["PRIVATE", "RSA", "OPENSSH"]), "KEY", *"-----"] if rng.random() < 0.5 else [rng.choice(_NAMES), ":"]
        else:
            part, head = value(rng, style), [rng.choice(_NAMES), *joint]
        tail = [joint[-1]] if joint[-1] in "\"'" and style != "bare" else []
        kept = tokens[j + (j < len(tokens) and tokens[j] in "\"'") :]
        marks = [O] * (start + len(head)) + [B] + [I] * (len(part) - 1) + [O] * (len(tail) + len(kept))
        out.append((tokens[:start] + head + part + tail + kept, [y if k < start + len(head) + len(part) + len(tail) else labels[len(labels) - len(marks) + k] for k, y in enumerate(marks)]))
    for _ in range(2):
        part = decoy(rng, plain)
        out.append((tokens[:start] + part + tokens[j:], labels[:start] + [O] * len(part) + labels[j:]))
    return out


def planted(tokens: list[str], labels: list[int], rng: random.Random) -> list[tuple[list[str], list[int]]]:
    """A plain window as it is, with a decoy, and with a made-up secret put in somewhere."""
    base = [O] * len(tokens)
    at = rng.randrange(len(tokens) + 1)
    made = variants(tokens[:at] + ["x"] + tokens[at:], base[:at] + [B] + base[at:], rng)
    return [(tokens, base), made[rng.randrange(len(STYLES))], made[len(STYLES)]]


#: Kinds of text that plain windows come from alike, so that rare kinds are among them: much in capitals, many symbols or digits, others.
PLAIN_KINDS = (r"\p{Lu}", r"[^\p{L}\s]")


def fitting_sample(df: DataFrame, id_col: str, text_col: str) -> list[tuple[list[tuple[str, str]], list[int], int, bool]]:
    """Labelled windows, and whether each is held out: at most FIT_WINDOWS, variants included, of the first FIT_DOCS documents
    (by a hash) that hold secret-like text, and planted() windows of the first PLAIN_DOCS of each kind of text.

    The hashes are picked first, so that no task is sent more than their texts."""
    text = F.col(f"`{text_col}`")
    hashed = df.select(F.xxhash64(F.lit(11), F.col(f"`{id_col}`"), text).alias("h"), text.alias("text"))
    worth = F.lit(False)
    for name in _WORTH:
        worth = worth | F.contains(F.lower("text"), F.lit(name))
    first = [r["h"] for r in hashed.where(worth).select("h").distinct().orderBy("h").limit(FIT_DOCS).collect()]
    share = lambda rx: F.regexp_count("text", F.lit(rx)) / F.greatest(F.length("text"), F.lit(1))
    kind = F.when(share(PLAIN_KINDS[0]) > 0.2, 0).when(share(PLAIN_KINDS[1]) > 0.1, 1).otherwise(2)
    other = hashed.where("text is not null and text != ''").select(kind.alias("kind"), "h").distinct()
    # by kind the least of another hash: the ends of an aggregate of bounded size, so the texts are read once
    least = lambda k: other.where(F.col("kind") == k).orderBy(F.xxhash64(F.lit(7), "h")).limit(PLAIN_DOCS)
    plain = [r["h"] for r in least(0).unionByName(least(1)).unionByName(least(2)).collect()]

    def cutout(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"h": [], "i": [], "shapes": [], "words": [], "labels": [], "kind": []}
        for h, text in zip(cols["h"], cols["text"]):
            rng = random.Random(h)
            windows: list[tuple[list[str], list[int]]] = []
            if h in secret_hashes:
                own = windows_of(text)[:FIT_OF_DOC]
                windows += [*own, *(v for w in own for v in variants(*w, rng))]
            if h in plain_hashes and not value_spans(text):
                windows += [x for w in some_windows(text, rng) for x in planted(*w, rng)]
            for i, (tokens, labels) in enumerate(windows):
                looks = looks_of(tokens[: FIT_TOKENS + 24])
                for name, x in zip(out, (h, i, [a for a, _ in looks], [b for _, b in looks], labels[: FIT_TOKENS + 24], file_feature(tokens))):
                    out[name].append(x)
        return out

    secret_hashes, plain_hashes = set(first), set(plain)
    every = [*secret_hashes | plain_hashes]
    picked = hashed.where(F.col("h").isin(every)) if every else hashed.limit(0)
    one = picked.groupBy("h").agg(F.min("text").alias("text"))  # of repeated rows one
    cut_out = map_rows(one, cutout, "h long, i int, shapes array<string>, words array<string>, labels array<int>, kind int")
    rows = cut_out.orderBy("i", "h").limit(FIT_WINDOWS + 9 * PLAIN_DOCS * PLAIN_OF_DOC).collect()
    return [(list(zip(r["shapes"], r["words"])), list(r["labels"]), r["kind"], r["h"] % HELD_OUT == 0) for r in rows]


def some_windows(text: str, rng: random.Random) -> list[tuple[list[str], list[int]]]:
    """PLAIN_OF_DOC windows at random of a text without a secret."""
    tokens = _TOKEN.findall(text)
    starts = range(0, len(tokens), FIT_TOKENS)
    return [(tokens[at : at + FIT_TOKENS], [O] * len(tokens[at : at + FIT_TOKENS])) for at in rng.sample(starts, min(len(starts), PLAIN_OF_DOC))]


def segments(scores: np.ndarray, moves: np.ndarray) -> list[tuple[int, int, list[int], float]]:
    """(first, end, labels, margin) of what the best path tags: by how much it beats leaving the tokens out."""
    path, out, i = viterbi(scores, moves), [], 0
    while i < len(path):
        if path[i] == O:
            i += 1
            continue
        j = i
        while j < len(path) and path[j] != O:
            j += 1
        steps = [O] * (i > 0) + path[i:j] + [O] * (j < len(path))
        margin = sum(scores[t, path[t]] - scores[t, O] for t in range(i, j)) + sum(moves[a, b] - moves[O, O] for a, b in zip(steps, steps[1:]))
        out.append((i, j, path[i:j], float(margin)))
        i = j
    return out


def learned(sample: list[tuple[list[tuple[str, str]], list[int], int, bool]]) -> Field:
    """The field fitted on the windows that are not held out, with the margin that does best on those that are."""
    field = fit([x[:3] for x in sample if not x[3]])
    real, false = [], []
    for looks, labels, kind, held in sample:
        if held and looks:
            for i, j, _, margin in segments(field.emissions(looks) + field.files[kind], field.moves):
                (real if any(labels[i:j]) else false).append(margin)
    # the least margin of least cost
    cost = lambda m: FALSE_COST * sum(x >= m for x in false) + sum(x < m for x in real)
    field.margin = min([0.0, *(x + 1e-6 for x in false)], key=lambda m: (cost(m), m))
    return field


class Tagger:
    """Tags whole texts; keeps which look each distinct token has, up to a bounded size of all.

    A look is all that the field sees of a token: its shape, its word and its part in the file feature.
    """

    #: About the bytes that known tokens may take.
    MAX_KNOWN = 64_000_000

    def __init__(self, field: Field):
        self.field = field
        zero = np.zeros(3, np.float32)
        pad = np.stack([field.weights.get((kind, off, "#"), zero) for kind, off in TEMPLATES]).astype(np.float32)
        self.known: dict[str, int] = {}
        self.looks: dict[tuple[str, str, int], int] = {}
        self.rows, self.flags, self.may = [pad], [0], [False]
        self.size = 0
        # the most that neighbours and the text add to B and to I over O
        self.most = np.zeros(3)
        for template in TEMPLATES[2:]:
            of = [w - w[O] for (kind, off, _), w in field.weights.items() if (kind, off) == template]
            self.most += np.maximum(np.max(of, axis=0), 0) if of else 0
        self.most += (field.files - field.files[:, :1]).max(0)

    def look_of(self, token: str) -> int:
        if self.size > self.MAX_KNOWN:
            self.known.clear()
            self.size = 0
        w = word(token)
        flag = flag_of(token, w)
        look = shape(token), w, flag
        i = self.looks.get(look)
        if i is None:
            i = self.looks[look] = len(self.rows)
            self.rows.append(self.field.emissions_of(token))
            self.flags.append(flag)
            own = self.rows[-1][:2].sum(0)
            self.may.append(bool((own - own[O] + self.most)[1:].max() > -self.field.bound - 1e-2))
        if len(token) <= 100:
            self.known[token] = i
            self.size += len(token) + 50
        return i

    def tag(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the spans that the best path over it tags by the margin at least, cut at white space outside quotes."""
        ids, ends = [0] * PAD, []
        get, look_of = self.known.get, self.look_of
        for text in texts:
            ids += [get(t) or look_of(t) for t in _TOKEN.findall(text)]  # no look is 0
            ends.append(len(ids))
            ids += [0] * PAD
        ids_ = np.asarray(ids, np.int32)
        table_, flags = np.stack(self.rows), np.asarray(self.flags, np.int8)
        starts = np.array([PAD] + [x + PAD for x in ends[:-1]], np.int64)
        # only tokens whose look may win, whatever their neighbours and the text are, get their sums
        may = np.flatnonzero(np.asarray(self.may)[ids_])
        e = np.zeros((len(may), 3), np.float32)
        for k, (_, off) in enumerate(TEMPLATES):
            e += table_[:, k][ids_[may + off]]
        of = np.searchsorted(starts, may, "right") - 1
        bits = np.array([2 * int((flags[ids_[a:b]] & 2).any()) + int((flags[ids_[a:b]] & 1).any()) for a, b in zip(starts.tolist(), ends)], np.int64)
        e += self.field.files[bits[of]]
        open_ = (e[:, 1:].max(1) - e[:, 0]) > -self.field.bound - 1e-3
        may, e, of = may[open_], e[open_], of[open_]
        tagged: dict[int, list[tuple[int, int, list[int]]]] = {}
        for run in np.split(np.arange(len(may)), np.flatnonzero((np.diff(may) > 1) | (np.diff(of) > 0)) + 1) if len(may) else []:
            i = int(of[run[0]])
            # both neighbours of a run are O on the best path, or the text's ends
            before, after = may[run[0]] > starts[i], may[run[-1]] + 1 < ends[i]
            outside = np.array([[0, -1e9, -1e9]])
            s = np.concatenate([outside[: int(before)], e[run].astype(np.float64), outside[: int(after)]])
            first = int(may[run[0]] - starts[i]) - int(before)
            for a, b, labels, margin in segments(s, self.field.moves):
                if margin >= self.field.margin:
                    tagged.setdefault(i, []).append((first + a, first + b, labels))
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for i, parts in tagged.items():
            found = [m.span() for m in _TOKEN.finditer(texts[i])]
            for a, b, labels in parts:
                quoted = a > 0 and texts[i][found[a - 1][0]] in "\"'" and found[a - 1][1] == found[a][0]
                spans: list[tuple[int, int]] = []
                for k, y in zip(range(a, b), labels):
                    if y == I and spans and (quoted or spans[-1][1] == found[k][0]):
                        spans[-1] = spans[-1][0], found[k][1]
                    else:
                        spans.append(found[k])
                out[i] += [x for x in spans if x[1] - x[0] >= LEAST]
        return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (start, end, kind), code points, end exclusive, by start, then kind; one row a row.

    Kinds: assign, access and hex (the base patterns, every match), crf (what the field tags elsewhere: spans
    that touch no base span). The field is fitted on a bounded sample labelled by the base patterns and on variants of
    its windows, and on windows of plain documents, as they are and with made-up secrets, see fitting_sample; a fifth of
    the documents is held out to choose the margin that a span needs. It is applied to every whole text, very long ones
    too; a small or one-sided table gives it few windows, and fewer finds. Spans end at white space outside quotes. A null or empty text has no spans; repeated rows are tagged
    alike; a null id is kept; other columns of df are not read. An empty df gives no rows.
    """
    kind = dict(df.dtypes)[id_col]
    field = learned(fitting_sample(df, id_col, text_col))
    model = df.sparkSession.sparkContext.broadcast(field)  # bounded: weights of a few hundred shapes and words
    held: list[Tagger] = []

    def scan(cols: dict[str, list]) -> dict[str, list]:
        tagger = held[0] if held else held.append(Tagger(model.value)) or held[0]
        texts = [t or "" for t in cols["text"]]
        spans = []
        for text, tagged in zip(texts, tagger.tag(texts)):
            base = base_spans(text)
            extra = [(a, b, CRF) for a, b in tagged if not any(a < y and x < b for x, y, _ in base)]
            all_ = sorted(base + extra, key=lambda s: (s[0], [*BASE, CRF].index(s[2])))
            spans.append([{"start": a, "end": b, "kind": k} for a, b, k in all_])
        return {"doc_id": cols["doc_id"], "spans": spans}

    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(docs, scan, f"doc_id {kind}, spans array<struct<start: int, end: int, kind: string>>", rows=128)


def op6_secret_crf(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != CRF)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"),
    )


QUERIES = {"op6_secret_crf": op6_secret_crf}
ORACLES: dict[str, str] = {}
