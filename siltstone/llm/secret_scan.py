"""Secret scan: fixed patterns, and a character convolutional network over further candidates.

Base findings are the matches of three fixed patterns. A candidate is any other run of key
characters, or the rest of one beside a base finding: of 8 or more with a digit or a capital after a small letter, of 16
or more, or of 6 or more where a lead word (password, key, login and the like) stands up to ``NEAR`` characters before. The network sees
the characters of the candidate (its first 32 and last 16 where it is longer than 48; such a candidate is also
seen in overlapping windows of 48 and in parts, so that it is seen whole) between 24 characters of context before and 8 after: an embedding per
character, one convolution of width 5, a maximum over each of the three parts, and a logistic output. It is
written in numpy and trained at first use on labelled findings: by default a set made by a seeded rule
(keys in the contexts and forms that leaks have, against identifiers, paths, dates, checksums and words),
or rows the caller labels. Scores are calibrated on a held-out third (Platt scaling), and the threshold is the
one of best precision among those that recall ``RECALL`` of the held-out secrets.

Scale: a map over rows; the network is some 4,000 numbers. Whole texts are scanned, in linear time.

Cases: null text is empty and has no findings; repeated rows are treated alike; offsets count code points,
ends are exclusive; a finding that the network adds never overlaps a base finding.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
# Words that announce a secret.
LEAD_WORDS = (
    "passw", "passphrase", "passcode", "passkey", "pwd", "secret", "token", "credential", "bearer", "apikey", "api key", "api_key", "auth", "login", "private key", "access key",
    "kennwort", "contrase", "mot de passe",
)
LEAD = re.compile("|".join(LEAD_WORDS), re.I)
NEAR = 24
#: Labelled findings that the rule makes.
FINDINGS = 9_000
PART = re.compile(r"[A-Za-z0-9+_-]{8,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RECALL = 0.98
BEFORE, HEAD, TAIL, AFTER = 24, 32, 16, 8
WIDTH = BEFORE + HEAD + TAIL + AFTER
PARTS = ((0, BEFORE), (BEFORE, BEFORE + HEAD + TAIL), (BEFORE + HEAD + TAIL, WIDTH))
EMBED, FILTERS, REACH = 8, 24, 5
_ORDER = {k: i for i, k in enumerate(KINDS)}

#: Character -> index: 0 nothing, 1-94 printable ASCII, 95 a letter beyond ASCII, 96 any other.
SYMBOLS = 97


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns' findings, by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # a run of 24 hexadecimal digits lies within a run of visible characters as long
    if any(len(t) >= 24 for t in text.split()):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that the network scores, without what base findings cover."""
    out, k = [], 0
    low = text.lower()
    # plain searches are quick; most texts hold none of the words
    leads = [m.end() for m in LEAD.finditer(text)] if any(w in low for w in LEAD_WORDS) else []
    reach: list[list[int]] = []  # base findings, overlapping ones as one
    for s, e in sorted((s, e) for _, s, e in base):
        if reach and s <= reach[-1][1]:
            reach[-1][1] = max(reach[-1][1], e)
        else:
            reach.append([s, e])
    for m in CANDIDATE.finditer(text):
        at, last = m.span()
        led = (lead := bisect_right(leads, at)) > 0 and at - leads[lead - 1] <= NEAR
        if last - at < 16 and not led and (last - at < 8 or not MIXED.search(m[0])):
            continue
        while k < len(reach) and reach[k][1] <= at:
            k += 1
        free, j = [], k
        while j < len(reach) and reach[j][0] < last:
            free.append((at, reach[j][0]))
            at, j = max(at, reach[j][1]), j + 1
        for start, end in (*free, (at, last)):
            run = text[start:end]
            start, end = start + len(run) - len(run.lstrip(".=-/+_")), end - len(run) + len(run.rstrip(".-/+_"))
            if end - start >= 16 or end - start >= 8 and MIXED.search(text, start, end) or end - start >= 6 and led:
                out.append((start, end))
    return out


def views(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The spans to score for a candidate: itself, and where it is too long to be seen whole, its windows and parts."""
    seen, size = [(start, end)], HEAD + TAIL
    if end - start > size:
        seen += [(min(at, end - size), min(at, end - size) + size) for at in range(start, end - size // 2, size // 2)]
        seen += [m.span() for m in PART.finditer(text, start, end) if m.end() - m.start() <= size]
    return seen


def window(text: str, start: int, end: int) -> str:
    """The characters the network sees, at fixed places; NUL where there is none."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    body = text[start:end]
    head, tail = (body, "") if end - start <= HEAD else (body[:HEAD], body[max(HEAD, len(body) - TAIL) :])
    return before + head.ljust(HEAD, "\0") + tail.ljust(TAIL, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def codes(windows: list[str]) -> np.ndarray:
    """(windows, WIDTH) of character indices."""
    points = np.frombuffer("".join(windows).encode("utf-32-le", "replace"), np.uint32).reshape(-1, WIDTH)
    out = np.where((points >= 33) & (points < 127), points - 32, 96).astype(np.int64)
    out[points > 190] = 95
    out[points == 0] = 0
    return out


@dataclass
class Net:
    embed: np.ndarray
    kernel: np.ndarray  # (REACH * EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def columns(self, x: np.ndarray) -> np.ndarray:
        e = np.pad(self.embed[x], ((0, 0), (REACH // 2, REACH // 2), (0, 0)))
        return np.concatenate([e[:, k : k + WIDTH] for k in range(REACH)], axis=2)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        cols = self.columns(x)
        act = np.maximum(cols @ self.kernel + self.bias, 0)
        tops = [act[:, a:b].argmax(axis=1) + a for a, b in PARTS]
        pooled = np.concatenate([np.take_along_axis(act, t[:, None, :], 1)[:, 0] for t in tops], axis=1)
        return cols, tops, pooled, pooled @ self.out + self.out_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        if not len(x):
            return np.zeros(0)
        z = np.concatenate([self.forward(x[k : k + 512])[-1] for k in range(0, len(x), 512)])
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))


def train(windows: list[str], y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 3e-3, recall: float = RECALL, seed: int = 5) -> Net:
    """Fit by Adam on two thirds of the rows; calibrate and choose the threshold on the rest."""
    rng = np.random.default_rng(seed)
    x = codes(windows)
    held = np.random.default_rng(seed + 1).random(len(y)) < 1 / 3
    net = Net(rng.normal(0, 0.3, (SYMBOLS, EMBED)), rng.normal(0, 0.2, (REACH * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS), 0.0)
    params = {"embed": net.embed, "kernel": net.kernel, "bias": net.bias, "out": net.out}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    rows, step = np.flatnonzero(~held), 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), batch):
            part = rows[at : at + batch]
            step += 1
            cols, tops, pooled, z = net.forward(x[part])
            err = (1 / (1 + np.exp(-z)) - y[part]) / len(part)
            grads = {"out": pooled.T @ err + 1e-4 * net.out, "kernel": 1e-5 * net.kernel, "bias": np.zeros(FILTERS), "embed": np.zeros_like(net.embed)}
            net.out_bias -= rate * err.sum()
            back = err[:, None] * net.out * (pooled > 0)
            for p, top in enumerate(tops):
                g = back[:, p * FILTERS : (p + 1) * FILTERS]
                seen = np.take_along_axis(cols, top[:, :, None], 1)  # (rows, filters, reach * embed)
                grads["kernel"] += np.einsum("nf,nfc->cf", g, seen)
                grads["bias"] += g.sum(0)
                into = g[:, :, None] * net.kernel.T[None]  # gradient of the columns
                for k in range(REACH):
                    place = top + k - REACH // 2
                    ok = (place >= 0) & (place < WIDTH)
                    n, f = np.nonzero(ok)
                    np.add.at(grads["embed"], x[part][n, place[n, f]], into[n, f, k * EMBED : (k + 1) * EMBED])
            for k, v in params.items():
                m, s = moments[k]
                m += 0.1 * (grads[k] - m)
                s += 0.001 * (grads[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    z = net.forward(x[held])[-1]
    net.scale, net.shift = platt(z, y[held])
    p = net.score(x[held])
    net.threshold = choose_threshold(p, y[held], recall)
    return net


def choose_threshold(p: np.ndarray, y: np.ndarray, recall: float) -> float:
    """The threshold of best precision among those that keep the recall; the middle of equals.

    Without secrets to learn from nothing is added.
    """
    secrets = np.sort(p[y == 1])
    if not len(secrets):
        return 1.1
    tried = np.linspace(0, float(secrets[int((1 - recall) * len(secrets))]), 200)
    precision = np.array([(y[p >= t] == 1).mean() for t in tried])
    return float(np.median(tried[precision == precision.max()]))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift of a logistic calibration, by Newton's method with smoothed targets."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - target) * z).sum(), (p - target).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return a, b


# The parts from which the rule makes labelled findings.
LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALNUM = LOWER + LOWER.upper() + DIGITS
SYLLABLES = "an the on ing er re in ti st ent or ed es al men que lo dos sch ung tion pre con ver ria".split()
LEADS = (
    "password is ", "the passphrase: ", "pwd=", "Authorization: Bearer ", "bearer ", "credentials ", "private key ", "access key: ", "auth_key = '",
    "client id and key ", "key=", "aws_access ", "login with ", "apikey ", "session key ", "signing key ", "secret ", "token ", "X-Auth: ", "pass: ",
)
PLAIN_LEADS = ("see ", "in ", "file ", "at ", "from ", "page ", "commit ", "sha256 ", "checksum ", "etag ", "order ", "version ", "id ", "ref. ", "invoice ", "date ", "build ", "image ")
PREFIXES = ("sk_live_", "sk-", "ghp_", "gho_", "xoxb-", "xoxp-", "glpat-", "AIza", "npm_", "pat_", "rk_live_", "dop_v1_", "SG.", "hf_")


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Windows and labels (1: a secret) made by rule; a third of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=k))
    word = lambda: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 4))))
    words = lambda k: " ".join(word() for _ in range(k))
    number = lambda a, b: str(int(rng.integers(a, b)))

    cluster = ("b", "c", "ch", "d", "f", "g", "gn", "h", "l", "lt", "m", "n", "nd", "ng", "p", "pf", "qu", "r", "rs", "s", "sch", "st", "t", "th", "tz", "v", "x", "z")
    vowel = ("a", "e", "i", "o", "u", "au", "ei", "eu", "eau", "io", "ou", "ui")

    def letters(least: int) -> str:
        """A word of letters only, as prose has it."""
        made = pick(("", "", "", "un", "ver", "inter"))
        while len(made) < least:
            made += (word() if rng.random() < 0.3 else "") + pick(cluster) + pick(vowel) + pick(("", "", pick(cluster)))
        return pick((made, made, made.capitalize(), made.upper()))

    def path() -> str:
        return pick(("/", "/", "-", "_", ".")).join(letters(int(rng.integers(3, 12))) for _ in range(12))[: int(rng.integers(16, 49))]

    def secret() -> tuple[str, str]:
        kind, size = int(rng.integers(7)), int(rng.integers(20, 56))
        if kind == 6:  # a short one, which its lead alone announces
            made = chars(ALNUM, int(rng.integers(10, 20)))
            return pick(LEADS), made if MIXED.search(made) else made + number(10, 99)
        if kind == 5:
            return pick(LEADS), chars(LOWER + LOWER.upper(), size)
        if kind == 0:
            return (pick(LEADS) if rng.random() < 0.5 else ""), pick(PREFIXES) + chars(ALNUM, size)
        if kind == 1:
            part = lambda k: chars(ALNUM + "-_", k)
            return (pick(LEADS) if rng.random() < 0.5 else ""), f"eyJ{part(17)}.eyJ{part(30)}.{part(30)}"
        alphabet = (ALNUM, ALNUM + "+/", ALNUM + "_-")[kind - 2]
        return pick(LEADS), chars(alphabet, size) + ("=" if kind == 3 and rng.random() < 0.5 else "")

    def harmless() -> tuple[str, str]:
        kind = int(rng.integers(21))
        if kind == 19:
            return (pick(PLAIN_LEADS) if rng.random() < 0.5 else ""), f"{pick((letters(4).lower(), letters(3).lower() + '.' + number(0, 100)))}@"
        if kind == 20:
            return pick(PLAIN_LEADS), pick(("//", "")) + pick(("www.", "")) + "/".join([letters(5).lower() + ".com", letters(4).lower(), number(1990, 2030), number(10, 13), "-".join(letters(4).lower() for _ in range(5)) + pick((".html", "", "/"))])
        if kind == 15:  # prose after a lead
            return pick(LEADS), letters(int(rng.integers(6, 12))).lower()
        if kind == 16:
            return pick(LEADS), word() + pick(("", "", "-" + word()))
        if kind >= 17:  # names in programs
            parts = [letters(int(rng.integers(3, 8))) for _ in range(int(rng.integers(2, 5)))]
            return pick(("", *PLAIN_LEADS)), pick(("_".join(parts).upper(), "".join(x.capitalize() for x in parts), "-".join(parts).lower() + ".js", ".".join(parts).lower()))
        if kind >= 9:
            return (pick(PLAIN_LEADS) if rng.random() < 0.3 else ""), path() if kind == 14 else letters(int(rng.integers(14, 24)))
        lead = pick(PLAIN_LEADS) if rng.random() < 0.6 else ""
        year = number(1990, 2030)
        made = (
            lambda: "/".join([word(), year, number(1, 13), word() + ".html"]),
            lambda: "-".join([word(), word(), number(1, 99), word(), number(1, 999)]),
            lambda: f"{year}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 29)):02d}T{int(rng.integers(24)):02d}:00",
            lambda: f"{word()}.{number(1, 99)}.{number(0, 99)}-{word()}-{number(0, 9)}",
            lambda: "_".join([word().upper(), word().upper(), number(1, 9999), word().upper()]),
            lambda: f"www.{word()}{number(1, 99)}.com/{word()}/{word()}",
            lambda: "-".join(chars("abcdef" + DIGITS, k) for k in (8, 4, 4, 4, 12)),
            lambda: pick(("sha1-", "sha256-", "md5-", "v")) + chars("ABCDEF" + DIGITS, int(rng.integers(16, 40))),
            lambda: word() + word() + word() + word() + number(1, 9999),
        )[kind]()
        return lead, made

    windows, y = [], []
    while len(y) < n:
        label = len(y) % 3 == 0
        lead, body = secret() if label else harmless()
        quote = pick(("", "", "'", '"'))
        text = f"{words(4)}{pick((' ', chr(10), '. '))}{lead}{quote}"
        # a view into a longer run
        inner = rng.random() < 0.25
        text += path() + "/" if inner else ""
        start = len(text)
        text += body + ("/" + path() if inner else "") + quote + pick((" ", ".", ", ", "\n")) + words(3)
        if len(body) >= 6:
            windows.append(window(text, start, start + len(body)))
            y.append(label)
    return windows, np.array(y, dtype=np.float64)


@lru_cache(maxsize=2)
def default_net(n: int = FINDINGS) -> Net:
    return train(*labelled_findings(n))


def findings(texts: list[str], net: Net) -> list[list[tuple[str, int, int]]]:
    """All findings of every text, by start, then kind."""
    every = [base_spans(t) for t in texts]
    places = [(i, s, e, v) for i, t in enumerate(texts) for s, e in candidates(t, every[i]) for v in views(t, s, e)]
    found: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for at in range(0, len(places), 4_096):
        part = places[at : at + 4_096]
        p = net.score(codes([window(texts[i], *v) for i, _, _, v in part]))
        for (i, s, e, v), ok in zip(part, p >= net.threshold, strict=True):
            if ok:
                found.setdefault((i, s, e), []).append(v)
    for (i, s, e), seen in found.items():
        # a candidate that is no secret as a whole may hold some; overlapping ones are one
        end = s
        for start, stop in [(s, e)] if (s, e) in seen else sorted(seen):
            if start < end:
                every[i][-1] = ("net", every[i][-1][1], max(end, stop))
            else:
                every[i].append(("net", start, stop))
            end = max(end, stop)
    return [sorted(f, key=lambda s: (s[1], _ORDER[s[0]])) for f in every]


FOUND = "array<struct<kind: string, start: bigint, end: bigint>>"


def with_findings(df: DataFrame, text_col: str = "text", name: str = "findings", net: Net | None = None) -> DataFrame:
    """``df`` and an array of each row's findings: kind, start, end."""
    shared = df.sparkSession.sparkContext.broadcast(net or default_net())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        found = findings(texts.to_pylist(), shared.value)
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], kind)

    return df.withColumn(name, scan.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))


def digest(df: DataFrame, id_col: str = "doc_id", name: str = "findings"):
    """Counts, the hash of the base findings and all findings as text."""
    found = F.col(name)
    only = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return df.select(
        id_col, *[only(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.filter(found, lambda s: s["kind"] != "net")).cast("binary"), 256).alias("base_sha256"),
        listed(found).alias("spans"), only("net").alias("n_net"),
    )


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """A text with its findings replaced; overlapping ones are one."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sha256(spans: list[tuple[str, int, int]]) -> str:
    """The digest of base findings, as the query gives it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
