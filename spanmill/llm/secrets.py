r"""Secret scans: patterns, and a character convolutional network over every candidate in its context.

Base findings come from three patterns and always stay. Candidates are the values of the base findings and all runs of at
least 16 characters of [A-Za-z0-9+/_.=-], or their pieces beside base findings. Each is read with LEFT characters before and
RIGHT after it, TOKEN characters at a time: a longer one in overlapping windows, of which the highest score counts. A
network of two convolutions, max pooling and a dense layer, written in numpy, says how likely it is a secret; what reaches
its shape's threshold is a finding of the kind model.

It is trained on labelled findings made from a seed: keys, tokens, passwords and connection strings, against identifiers,
paths, versions, long words, numbers and placeholders; and on findings of the documents themselves: values of base findings
against look-alikes, the runs of letters or digits outside them, at most CORPUS_EXAMPLES different ones of each, those of the
smallest hash. A quarter of these is used for nothing, so that it can be measured on. One half of them trains, a quarter calibrates the scores
(Platt scaling), and the last quarter sets a threshold for each shape of a candidate (hex, digits, letters of one case, short,
mixed): the largest that keeps RECALL of its secrets.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.session import text_batches


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(" + "|".join(_any_case(k) for k in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: Characters that the network reads of a candidate, and around it.
LEFT, TOKEN, RIGHT = 24, 48, 8
WIDTH = LEFT + TOKEN + RIGHT
#: Places between the windows of a long candidate.
WINDOW_STEP = 24
RECALL, TRAIN_EXAMPLES, SEED = 0.98, 8000, 11
#: Shapes of a candidate with a threshold each; one with fewer held-out secrets takes that of all together.
SHAPES, LEAST_SECRETS = ("hex", "digits", "letters", "short", "mixed"), 20
#: Findings of the documents that the network is trained on, at most of each label, and shapes that count as look-alikes: others
#: outside the base patterns may be secrets.
CORPUS_EXAMPLES, ALIKE = 1000, (1, 2)
CHANNELS, KERNEL, EMBED = 24, 5, 12


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, leftmost and non-overlapping for each kind."""
    return [(start, kind, end) for start, kind, end, _ in base_findings(text)]


def base_findings(text: str) -> list[tuple[int, int, int, int]]:
    """base_spans with the place where the finding's value begins."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of all that may be a secret: the values of base findings, and runs or their pieces beside them."""
    found, taken, k = {(value, end) for _, _, end, value in base}, [], 0
    for start, _, end, _ in base:
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    for m in CANDIDATE.finditer(text):
        at, stop = m.span()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        i = k
        while at < stop:
            start, end = taken[i] if i < len(taken) and taken[i][0] < stop else (stop, stop)
            if start - at >= LEAST:
                found.add((at, start))
            at, i = end, i + 1
        k = max(k, i - 1)
    return sorted(found)


def shape_of(token: str) -> int:
    """The place of a candidate's shape in SHAPES."""
    core = re.sub(r"[+/_.=-]", "", token)
    if len(token) < LEAST:
        return 3
    if core.isdigit() or not core:
        return 1
    if any(c.isdigit() for c in core) and not (set(core) - set("0123456789abcdef") and set(core) - set("0123456789ABCDEF")):
        return 0
    return 2 if core.isalpha() and (core[1:] == core[1:].lower() or core == core.upper()) else 4


def window_spans(a: int, b: int) -> list[tuple[int, int]]:
    """The candidate from its start, and overlapping windows over the rest of one of more than TOKEN characters."""
    rest = range(a + WINDOW_STEP, b - TOKEN, WINDOW_STEP)
    return [(a, b), *[(s, s + TOKEN) for s in rest], *([(b - TOKEN, b)] if b - a > TOKEN else [])]


def code_points(text: str, start: int, end: int) -> np.ndarray:
    """One example: context, token and context as character classes; 0 pads, 1 stands for all non-ASCII."""
    out = np.zeros(WIDTH, dtype=np.uint8)
    left, token, right = text[max(0, start - LEFT) : start], text[start : min(end, start + TOKEN)], text[end : end + RIGHT]
    for at, part in ((LEFT - len(left), left), (LEFT, token), (LEFT + TOKEN, right)):
        raw = [o if 1 < (o := ord(c)) < 128 else 1 for c in part]
        out[at : at + len(raw)] = raw
    return out


SYLLABLES = "an re th ing er on es ti le de ou st ung keit sch ein ver lich ge che tion que oi elle ment la os ñe es ca do ra mi ble ly wh ed un für ch and ho".replace("ñ", "n").replace("ü", "u").split()


def labelled_findings(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n labelled examples, half of them secrets, and their shapes, from a seed: random keys in usual settings against look-alikes in prose."""
    r = random.Random(seed)
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alnum, b64 = low + up + dig, low + up + dig + "+/"
    rnd = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    word = lambda a=1, b=4: "".join(r.choice(SYLLABLES) for _ in range(r.randint(a, b)))
    words = lambda sep, a, b: sep.join(word() for _ in range(r.randint(a, b)))
    hexes = lambda: rnd("0123456789abcdef" if r.random() < 0.8 else "0123456789ABCDEF", *r.choice(((32, 32), (40, 40), (64, 64), (24, 48))))
    named = (" key=", ' secret: "', ' token = "', " API_KEY=", " password: ", ' passwd="', " auth_token=", " Bearer ", "Authorization: Basic ", " client_secret = '", " pwd=", ' TOKEN = "', " apikey: ")
    bare = (" ", "\n", "(", "'", ": ", " = ")
    secret_kinds = (
        lambda: (r.choice(named + bare), rnd(alnum, 24, 64)), lambda: (r.choice(named + bare), rnd(b64, 38, 44) + "=" * r.randint(0, 2)), lambda: (r.choice(named + bare), r.choice(("ghp_", "gho_", "npm_", "glpat-")) + rnd(alnum, 36, 36)),
        lambda: (r.choice(named + bare), r.choice(("sk-", "sk_live_", "rk_test_")) + rnd(alnum, 24, 48)), lambda: (r.choice(named + bare), "xoxb-" + rnd(dig, 10, 12) + "-" + rnd(alnum, 24, 24)), lambda: (r.choice(named + bare), "AKIA" + rnd(up + dig, 16, 16)),
        lambda: (r.choice(named + bare), "eyJ" + rnd(alnum, 20, 30) + "." + rnd(alnum + "_-", 30, 60) + "." + rnd(alnum + "_-", 30, 43)), lambda: (r.choice(named + bare), "AIza" + rnd(alnum + "_-", 35, 35)),
        lambda: (r.choice(named + bare), hexes()), lambda: (r.choice(named), hexes()), lambda: (r.choice(named), rnd(alnum, 8, 15)), lambda: (r.choice(named), word(2, 3) + rnd(dig, 2, 4) + rnd(alnum, 0, 3)),
        lambda: (r.choice(named + bare), rnd(up + "234567", 26, 52)), lambda: (r.choice(named), rnd(low, 20, 40)), lambda: (r.choice(named), rnd(dig, 8, 20)), lambda: (r.choice((" postgres://" + word() + ":", " mysql://root:", " https://" + word() + ":")), rnd(alnum, 16, 24)), lambda: ("-----BEGIN PRIVATE KEY-----\n", rnd(b64, 64, 64)),
    )
    plain_kinds = (
        lambda: (r.choice(bare), words("-", 4, 7)), lambda: (r.choice(bare), words("/", 4, 7) + r.choice((".html", ".py", ""))), lambda: (r.choice(bare), words(".", 3, 3) + f".v{r.randint(1, 30)}"), lambda: (r.choice(bare), words("_", 4, 4) + f"_{r.randint(1, 999)}"),
        lambda: (r.choice(bare), f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T10.20.{r.randint(10, 59)}"), lambda: (r.choice(bare), rnd(dig, 16, 24)), lambda: (r.choice(bare), word(6, 10)), lambda: (r.choice(bare), word(6, 10).upper()), lambda: (". ", word(6, 10).capitalize()),
        lambda: (r.choice(bare), word(5, 7).capitalize() + str(r.randint(0, 9))), lambda: (r.choice(bare), "".join(word().capitalize() for _ in range(r.randint(4, 7)))), lambda: (r.choice(bare), r.choice("=-._") * r.randint(16, 40) + r.choice(("", "1"))), lambda: (". ", word(2, 4) + "." + word(2, 4).capitalize()),
        lambda: (r.choice((" token: ", " secret = ", " password: ", " token=")), word(3, 5)), lambda: (" ", word() + "." + rnd(dig, 1, 2)),
        lambda: (r.choice(named), r.choice(("placeholder", "changeme", "your-key-here", "xxxxxxxxxxxx", "example-token", "undefined", "********".replace("*", "x"))) + r.choice(("", "-" + word(1, 2)))),
    )
    x, y, shapes = np.zeros((n, WIDTH), dtype=np.uint8), np.zeros(n), np.zeros(n, dtype=np.int64)
    for i in range(n):
        y[i] = i % 2
        lead, token = r.choice(secret_kinds if y[i] else plain_kinds)()
        before = " ".join(word() for _ in range(r.randint(0, 4)))
        text = before + lead + token + r.choice((" ", "\n", '"', ".", "", ")", "'")) + word()
        x[i] = code_points(text, len(before + lead), len(before + lead + token))
        shapes[i] = shape_of(token)
    return x, y, shapes


def corpus_findings(docs: DataFrame, text_col: str = "text", most: int = CORPUS_EXAMPLES) -> tuple[bytes, bytes, bytes, bytes]:
    """Examples of the documents: code points, labels, shapes and hashes of at most so many different ones of each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for value in batch.column(0):
                text = value.as_py() or ""
                findings = base_findings(text)
                values = {(begin, end) for _, _, end, begin in findings}
                for a, b in candidates(text, findings):
                    shape = shape_of(text[a:b])
                    if (a, b) in values or shape in ALIKE:
                        rows.add((int((a, b) in values), shape, code_points(text, a, b).tobytes()))
            cols = list(zip(*rows)) or [(), (), ()]
            hashes = [xxhash.xxh3_64_intdigest(x) >> 1 for x in cols[2]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*cols, hashes), (pa.int32(), pa.int32(), pa.binary(), pa.int64()))], names=["label", "shape", "example", "h"])

    each = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "label int, shape int, example binary, h long").dropDuplicates(["label", "example"])
    found = each.where("label = 0").orderBy("h", "example").limit(most).unionByName(each.where("label = 1").orderBy("h", "example").limit(most)).collect()
    packed = lambda name, kind: np.array([r[name] for r in found], dtype=kind).tobytes()
    return b"".join(bytes(r["example"]) for r in found), packed("label", np.float64), packed("shape", np.int64), packed("h", np.int64)


def unpacked_findings(corpus: tuple[bytes, bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Examples, labels, shapes, and to which quarter each belongs; quarter 0 is not trained on."""
    x, y, shapes, h = (np.frombuffer(b, dtype=k) for b, k in zip(corpus, (np.uint8, np.float64, np.int64, np.int64)))
    return x.reshape(len(y), WIDTH), y, shapes, h % 4


class CharCnn:
    """Embedding, two convolutions with ReLU, max over places, dense sigmoid; Adam, plain numpy."""

    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        f = np.float32
        self.w = {
            "e": g.normal(0, 0.5, (128, EMBED)).astype(f), "c1": g.normal(0, (2 / (KERNEL * (EMBED + 1))) ** 0.5, (KERNEL * (EMBED + 1), CHANNELS)).astype(f), "b1": np.zeros(CHANNELS, f),
            "c2": g.normal(0, (2 / (KERNEL * CHANNELS)) ** 0.5, (KERNEL * CHANNELS, CHANNELS)).astype(f), "b2": np.zeros(CHANNELS, f), "d": g.normal(0, 0.2, CHANNELS).astype(f), "b": np.zeros(1, f),
        }
        self.scale = (1.0, 0.0)
        self.thresholds = np.full(len(SHAPES), 0.5)
        self.recalls = np.full(len(SHAPES), np.nan)

    @staticmethod
    def _windows(x: np.ndarray) -> np.ndarray:
        n, length, c = x.shape
        v = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2)
        return np.ascontiguousarray(v).reshape(n, length - KERNEL + 1, KERNEL * c)

    def forward(self, x: np.ndarray, keep: bool = False):
        w = self.w
        inside = np.zeros((1, WIDTH, 1), dtype=np.float32)
        inside[0, LEFT : LEFT + TOKEN] = 1
        e = np.concatenate([w["e"][x], np.broadcast_to(inside, (len(x), WIDTH, 1))], axis=2)
        u1 = self._windows(e)
        a1 = np.maximum(u1 @ w["c1"] + w["b1"], 0)
        u2 = self._windows(a1)
        a2 = np.maximum(u2 @ w["c2"] + w["b2"], 0)
        top = a2.argmax(1)
        pooled = np.take_along_axis(a2, top[:, None, :], 1)[:, 0]
        z = pooled @ w["d"] + w["b"]
        return (z, (u1, a1, u2, top, pooled)) if keep else z

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 4e-3, seed: int = SEED) -> None:
        g = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = g.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                z, (u1, a1, u2, top, pooled) = self.forward(x[at], keep=True)
                dz = ((1 / (1 + np.exp(-z)) - y[at]) / len(at)).astype(np.float32)
                grad = {"d": pooled.T @ dz, "b": dz.sum(keepdims=True)}
                dp = dz[:, None] * self.w["d"] * (pooled > 0)
                rows = np.arange(len(at))
                grad["c2"], grad["b2"] = np.zeros_like(self.w["c2"]), dp.sum(0)
                da1 = np.zeros_like(a1)
                for c in range(CHANNELS):
                    grad["c2"][:, c] = u2[rows, top[:, c]].T @ dp[:, c]
                    back = dp[:, c, None] * self.w["c2"][:, c]
                    for k in range(KERNEL):
                        da1[rows, top[:, c] + k] += back[:, k * CHANNELS : (k + 1) * CHANNELS]
                da1 *= a1 > 0
                grad["b1"] = da1.sum((0, 1))
                grad["c1"] = u1.reshape(-1, u1.shape[2]).T @ da1.reshape(-1, CHANNELS)
                du = da1 @ self.w["c1"].T
                de = np.zeros((len(at), WIDTH, EMBED + 1), dtype=np.float32)
                for k in range(KERNEL):
                    de[:, k : k + du.shape[1]] += du[:, :, k * (EMBED + 1) : (k + 1) * (EMBED + 1)]
                grad["e"] = np.zeros_like(self.w["e"])
                np.add.at(grad["e"], x[at], de[:, :, :EMBED])
                step += 1
                for k, v in grad.items():
                    a, b = m[k]
                    a += 0.1 * (v - a)
                    b += 0.001 * (v * v - b)
                    self.w[k] -= rate * (1 - 0.95 * step / steps) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps on examples not trained on."""
        z = self.forward(x).astype(np.float64)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * z + b)))
            g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()])
            q = p * (1 - p)
            h = np.array([[(q * z * z).sum() + 1e-2, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
        self.scale = (float(a), float(b))

    def constrain(self, x: np.ndarray, y: np.ndarray, shapes: np.ndarray, recall: float = RECALL) -> None:
        """For each shape the largest threshold that keeps the recall, on examples used for nothing else."""
        p = self.score(x)
        least = lambda good: np.sort(good)[int((1 - recall) * len(good))]
        for k in range(len(SHAPES)):
            good = p[(y == 1) & (shapes == k)]
            self.thresholds[k] = least(good if len(good) >= LEAST_SECRETS else p[y == 1])
            self.recalls[k] = (good >= self.thresholds[k]).mean() if len(good) else np.nan

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        out = [1 / (1 + np.exp(-np.clip(a * self.forward(x[i : i + 512]).astype(np.float64) + b, -50, 50))) for i in range(0, len(x), 512)]
        return np.concatenate(out) if out else np.zeros(0)


@lru_cache(maxsize=4)
def trained(examples: int = TRAIN_EXAMPLES, seed: int = SEED, corpus: tuple[bytes, bytes, bytes, bytes] | None = None) -> CharCnn:
    """The network, trained on half of the labelled findings, calibrated on a quarter, its thresholds set on the last quarter. Of
    those of a corpus two quarters train and one calibrates."""
    x, y, shapes = labelled_findings(examples, seed)
    order = np.random.default_rng(seed).permutation(examples)
    fit, scale, held = order[: examples // 2], order[examples // 2 : examples * 3 // 4], order[examples * 3 // 4 :]
    net = CharCnn(seed)
    more = unpacked_findings(corpus or (b"", b"", b"", b""))
    own = lambda at, quarters: (np.concatenate([a[at], b[np.isin(more[3], quarters)]]) for a, b in ((x, more[0]), (y, more[1])))
    net.train(*own(fit, (1, 2)))
    net.calibrate(*own(scale, (3,)))
    net.constrain(x[held], y[held], shapes[held])
    return net


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: CharCnn | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end of all findings, by start, then kind, in code points).

    A value that both a pattern and the network find has a span of each kind. Null texts count as empty: no spans, the hash of
    the empty string. Texts and candidates of any length are read whole. Rows that repeat an id are scanned each on
    their own; other columns are not read, whatever their names. No rows give no rows.
    """
    text_batches(docs.sparkSession)
    net = net or trained(corpus=corpus_findings(docs, text_col))
    model = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = model.value
        for batch in batches:
            found, wanted, where = [], [], []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                findings = base_findings(text)
                base = [(start, kind, end) for start, kind, end, _ in findings]
                found.append((base, list(base)))
                for a, b in candidates(text, findings):
                    least = cnn.thresholds[shape_of(text[a:b])]
                    for start, end in window_spans(a, b):
                        wanted.append(code_points(text, start, end))
                        where.append((i, a, b, least))
            if wanted:
                hits = {at[:3] for at, p in zip(where, cnn.score(np.stack(wanted))) if p >= at[3]}
                for i, a, b in hits:
                    found[i][1].append((a, 3, b))
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(3)]
            shas = [hashlib.sha256(join_spans(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array([join_spans(s) for _, s in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
