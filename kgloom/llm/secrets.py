"""Secret scans: base patterns, and a character convolutional network over every candidate in its context.

Candidates are runs of eight or more characters that keys are made of, less what base findings cover, unless they
are plainly words and numbers joined by marks; and passwords in URLs. One longer than the network's view is seen in
overlapping views, the highest of which counts.

The network is trained here, in numpy, on labelled findings: positive ones are those of the base patterns in
a bounded sample of the corpus and generated keys of common families; negative ones are plain words and numbers of
the corpus and generated look-alikes. Other candidates of the corpus have no label and are not learned from.
Calibration (Platt) uses other documents and other generated ones than training; the threshold is the highest that
keeps a set recall on positive findings there that no base pattern finds.

Null texts count as empty and have no spans; an empty table gives an empty result. Base spans always stay; ``model``
spans overlap no base span. Repeated rows are scanned each on its own, very long texts whole. A probability equal to
the threshold is a finding.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import annotate, batches, doc_text, scan

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run that is shorter fails at every place in it
TOKEN = re.compile(r"[A-Za-z0-9+/_.=~-]{8,}")
#: Words in one case or capitalised, and numbers, joined by marks.
PLAIN = re.compile(r"[+/_.=~-]*(?:(?:[A-Z]?[a-z]{1,19}|[A-Z]{1,19}|[0-9]+)(?:[+/_.=~-]+|$))+")
CREDENTIAL = re.compile(r"://[^\s/:@]+:([^\s/@]{4,})@")
#: Characters of the network's view: of the candidate, and of either side; and between starts of views of one candidate.
BODY, SIDE, STEP = 64, 24, 48
#: So many views are scored at a time.
VIEWS = 2048
WIDTH = BODY + 2 * SIDE


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base finding."""
    out = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted((a, k, b) for a, b, k in out)


def _uncovered(a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans (sorted by start) leave of a span."""
    out = []
    for x, _, y in base:
        if x < b and a < y:
            out.append((a, x))
            a = max(a, y)
    return [(x, y) for x, y in (*out, (a, b)) if y - x >= 4]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that may be secrets and touch no base span."""
    out = []
    for m in TOKEN.finditer(text):
        if not PLAIN.fullmatch(m[0]):
            for a, b in _uncovered(*m.span(), base) if base else [m.span()]:
                body = text[a:b].strip(".")
                if len(body) >= 8 and not PLAIN.fullmatch(body):
                    a += len(text[a:b]) - len(text[a:b].lstrip("."))
                    out.append((a, a + len(body)))
    if "://" in text:
        for m in CREDENTIAL.finditer(text):
            out = [*(c for c in out if c[1] <= m.start(1) or c[0] >= m.end(1)), *_uncovered(*m.span(1), base)]
        out.sort()
    return out


def views_of(a: int, b: int) -> list[tuple[int, int]]:
    """Parts of a candidate that the network sees at once; they overlap and leave nothing out."""
    return [(i, min(i + BODY, b)) for i in range(a, max(a + 1, b - BODY + STEP), STEP)]


def _class(c: str) -> int:
    return ord(c) - 31 if " " <= c <= "~" else 96 if c.isalpha() else 97


def view(text: str, a: int, b: int):
    """Character classes around a part of a candidate of at most BODY characters (0: none), and where it is."""
    import numpy as np

    x, mark = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.float32)
    body = text[a:b][:BODY]
    s = text[max(0, a - SIDE) : a].rjust(SIDE, "\0") + body + text[b : b + SIDE]
    for i, c in enumerate(s):
        x[i] = 0 if c == "\0" else _class(c)
    mark[SIDE : SIDE + len(body)] = 1
    return x, mark


class CharNet:
    """Embedding, one convolution with ReLU, maximum and mean over the candidate, logistic output."""

    DIM, FILTERS, SPAN = 12, 24, 5

    def __init__(self, seed: int = 7):
        import numpy as np

        r = np.random.default_rng(seed)
        fan = self.SPAN * (self.DIM + 1)
        self.p = {
            "e": r.normal(0, 0.5, (98, self.DIM)).astype(np.float32),
            "k": r.normal(0, (2 / fan) ** 0.5, (fan, self.FILTERS)).astype(np.float32),
            "c": np.zeros(self.FILTERS, np.float32),
            "w": r.normal(0, 0.2, 2 * self.FILTERS).astype(np.float32),
            "b": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x, mark):
        import numpy as np

        p = self.p
        z = np.concatenate((p["e"][x] * (x > 0)[..., None], mark[..., None]), axis=2)
        cols = np.lib.stride_tricks.sliding_window_view(z, self.SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - self.SPAN + 1, -1)
        h = np.maximum(cols @ p["k"] + p["c"], 0)
        top = h.argmax(axis=1)
        f = np.concatenate((np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)), axis=1)
        return cols, h, top, f, f @ p["w"] + p["b"][0]

    def logits(self, x, mark):
        import numpy as np

        return np.concatenate([self._forward(x[i : i + 512], mark[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x, mark):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x, mark) + self.shift, -40, 40)))

    def train(self, x, mark, y, rounds: int = 400, size: int = 96, rate: float = 0.004, seed: int = 7):
        import numpy as np

        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for t in range(1, rounds + 1):
            i = r.integers(0, len(x), size)
            xi, mi = x[i], mark[i]
            cols, h, top, f, out = self._forward(xi, mi)
            d = ((1 / (1 + np.exp(-out)) - y[i]) / size).astype(np.float32)
            df = d[:, None] * self.p["w"]
            n, places, _ = h.shape
            dh = np.repeat(df[:, None, self.FILTERS :] / places, places, axis=1)
            np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + df[:, None, : self.FILTERS], 1)
            dh *= h > 0
            dc = (dh @ self.p["k"].T).reshape(n, places, self.SPAN, self.DIM + 1)
            de = np.zeros_like(self.p["e"])
            for j in range(self.SPAN):
                at = xi[:, j : j + places]
                np.add.at(de, at, dc[:, :, j, : self.DIM] * (at > 0)[..., None])
            g = {"e": de, "k": np.einsum("npa,npf->af", cols, dh), "c": dh.sum(axis=(0, 1)), "w": f.T @ d, "b": np.array([d.sum()])}
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def calibrate(self, x, mark, y, recall: float, judged=None):
        """Platt scaling by Newton steps, then the highest threshold of at least ``recall`` on the positive ones (of those ``judged``)."""
        import numpy as np

        s = self.logits(x, mark).astype(np.float64)
        a, b = 1.0, 0.0
        want = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w = np.maximum(q * (1 - q), 1e-6)
            g = np.array([((q - want) * s).sum() + 1e-3 * a, (q - want).sum()])
            hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, g)
            a, b = a - step[0], b - step[1]
        self.scale, self.shift = float(a), float(b)
        found = np.sort(self.probability(x, mark)[(y > 0) & (judged if judged is not None else True)])
        self.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 0.5
        return self


def generated(n: int, words: list[str], seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): keys of common families, and tokens that look like keys but aren't."""
    r = random.Random(seed)
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda s, a, b: "".join(r.choice(s) for _ in range(r.randint(a, b)))
    word = lambda: r.choice(words)
    keys = [
        lambda: "ghp_" + pick(low + up + digit, 36, 36),
        lambda: "sk-" + pick(low + up + digit, 24, 48),
        lambda: "xoxb-" + pick(digit, 10, 12) + "-" + pick(low + up + digit, 20, 24),
        lambda: "AIza" + pick(low + up + digit + "_-", 35, 35),
        lambda: "eyJ" + pick(low + up + digit, 30, 60),
        lambda: pick(low + up + digit + "+/", 38, 64) + r.choice(["", "=", "=="]),
        lambda: pick("0123456789abcdef", 32, 64),
        lambda: pick("0123456789ABCDEF", 32, 64),
        lambda: "AKIA" + pick(up + digit, 16, 16),
        lambda: pick(low + up + digit, 20, 40),
        lambda: pick(low + up, 28, 44),
        lambda: "eyJ" + pick(low + up + digit, 20, 30) + ".eyJ" + pick(low + up + digit, 20, 40) + "." + pick(low + up + digit + "_-", 43, 43),
        lambda: pick(low + up, 4, 8) + pick(digit, 1, 4) + pick("!$%&*#", 0, 2) + pick(low + up + digit, 2, 6),
    ]
    others = [
        lambda: word() + "-" + word() + "-" + word() + pick(digit, 1, 4),
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + pick(digit, 1, 3),
        lambda: pick(digit, 16, 30),
        lambda: "_".join(word() for _ in range(3)) + "_v" + pick(digit, 1, 2),
        lambda: f"20{pick(digit, 2, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}_{word()}_{word()}",
        lambda: r.choice("xX0*a1=-_") * r.randint(16, 40) + "1",
        lambda: "+" + "-".join(pick(digit, 3, 4) for _ in range(5)),
        lambda: "your-" + word() + "-goes-here-" + pick(digit, 1, 3),
        lambda: word() + word() + word() + pick(digit, 1, 2),
        lambda: "=" * r.randint(10, 30) + pick(digit, 1, 3) + "=" * 10,
        lambda: word().title() + word().title() + word().title() + r.choice(["", pick(digit, 1, 2)]),
        lambda: f"v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}-{word()}{r.randint(1, 9)}",
        lambda: word() + pick(digit, 2, 4) + "." + r.choice(["html", "json", "png", "tar.gz"]),
    ]
    leads = ["key = ", "auth: ", "bearer ", 'value="', "export KEY=", "", " ", "(", "id=", "use "]
    out = []
    for i in range(n):
        body = r.choice(keys if i % 2 else others)()
        before = " ".join(word() for _ in range(4)) + " " + r.choice(leads)
        out.append((f"{before}{body} {word()} {word()}.", len(before), len(before) + len(body), i % 2))
    return out


def fit(docs: DataFrame, sample: int = 4000, per_document: int = 3, n_generated: int = 4000, recall: float = 0.98) -> CharNet:
    """The network, from labelled findings of the corpus and ``n_generated`` made ones.

    Bounds on what is learned from: about ``sample`` documents, drawn by a hash of the id, with at most ``per_document``
    base findings and as many plain tokens each; ``2 * sample * per_document`` findings in all, in the order of the hash.
    """
    import numpy as np

    texts = doc_text(docs).where("text is not null and doc_id is not null")
    n = texts.count()
    drawn = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(min(1.0, sample / max(1, n)) * (1 << 30)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in batches(parts):
            rows = []
            for doc, t in zip(part.column("doc_id").to_pylist(), held, strict=True):
                s = t.decode()
                base = base_spans(s)
                plain = (m.span() for m in TOKEN.finditer(s) if PLAIN.fullmatch(m[0]))
                for label, found in ((1, [(a, b) for a, _, b in base][:per_document]), (0, list(islice(plain, per_document)))):
                    rows += [{"doc_id": doc, "x": s[max(0, a - SIDE) : a], "y": s[a:b][:BODY], "z": s[b : b + SIDE], "label": label} for a, b in found]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("x", pa.string()), ("y", pa.string()), ("z", pa.string()), ("label", pa.int32())]))

    found = drawn.mapInArrow(run, "doc_id long, x string, y string, z string, label int")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x", "y", "z").limit(2 * sample * per_document).collect()
    words = sorted({w for r in rows if not r.label for w in re.findall(r"[^\W\d_]{2,12}", r.x + " " + r.z)}) or ["word"]
    # (text, start, end, label, set aside for calibration, found by no base pattern)
    marked = [(r.x + r.y + r.z, len(r.x), len(r.x) + len(r.y), r.label, crc32(b"%d" % r.doc_id) % 4 == 0, False) for r in rows]
    for aside, k, seed in ((False, 3 * n_generated // 4, 11), (True, n_generated // 4, 12)):
        marked += [(t, a, b, y, aside, bool(candidates(t, base_spans(t)))) for t, a, b, y in generated(k, words, seed)]
    random.Random(3).shuffle(marked)
    seen = [view(*m[:3]) for m in marked]
    x, mark, y = np.array([s[0] for s in seen]), np.array([s[1] for s in seen]), np.array([m[3] for m in marked], np.float32)
    aside, judged = np.array([m[4] for m in marked]), np.array([m[5] for m in marked])
    return CharNet().train(x[~aside], mark[~aside], y[~aside]).calibrate(x[aside], mark[aside], y[aside], recall, judged[aside])


def _scored(net: CharNet, text: str, spans: list[tuple[int, int]]) -> list[float]:
    """The network's probability of each span: the highest of its views'."""
    import numpy as np

    of, out = [(k, v) for k, (a, b) in enumerate(spans) for v in views_of(a, b)], [0.0] * len(spans)
    for i in range(0, len(of), VIEWS):
        seen = [view(text, *v) for _, v in of[i : i + VIEWS]]
        p = net.probability(np.array([s[0] for s in seen]), np.array([s[1] for s in seen]))
        for (k, _), q in zip(of[i : i + VIEWS], p.tolist(), strict=True):
            out[k] = max(out[k], round(q, 6))
    return out


def find_secrets(docs: DataFrame, net: CharNet) -> DataFrame:
    """``doc_id, spans`` with kind, start, end and the network's probability of every finding."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("p", pa.float64())]))

    def prepare():
        n = sent.value

        def spans(t):
            s = (t or b"").decode()
            base = base_spans(s)
            met = [*base, *[(a, 3, b) for a, b in candidates(s, base)]]
            p = _scored(n, s, [(a, b) for a, _, b in met]) if met else []
            kept = [{"start": a, "kind": k, "end": b, "p": q} for (a, k, b), q in zip(met, p, strict=True) if k < 3 or q >= n.threshold]
            return sorted(kept, key=lambda f: (f["start"], f["kind"]))

        return lambda texts: (pa.array([spans(t) for t in texts], span),)

    return annotate(doc_text(docs), ["doc_id"], "spans array<struct<start:long,kind:int,end:long,p:double>>", prepare)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    found = find_secrets(docs, fit(docs))
    names = F.array(*[F.lit(k) for k in KINDS])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count(3).alias("n_model"),
    )
