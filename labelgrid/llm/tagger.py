"""Character-level bidirectional LSTM with CRF transitions in numpy: training and decoding."""

from __future__ import annotations

import functools
import random
import string

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tag 0 is outside; 1 + 2k begins kind k, 2 + 2k continues it.
N_TAGS = 1 + 2 * len(KINDS)
#: Characters of the text that training windows are cut from.
POOL = 500_000
#: Learnt transitions stay within this of zero; illegal ones are ruled out whatever their score.
MOVE = 0.75
_MARKS = string.punctuation
#: pad, digit, a-f, g-z, A-F, G-Z, other letter, space, line end, each ASCII mark, anything else
N_CLASSES = 10 + len(_MARKS)


@functools.cache
def _class_table() -> np.ndarray:
    out = np.full(0x250, N_CLASSES - 1, np.int8)
    for c in range(0x250):
        x = chr(c)
        if x in string.digits:
            out[c] = 1
        elif x in "abcdef":
            out[c] = 2
        elif x in string.ascii_lowercase:
            out[c] = 3
        elif x in "ABCDEF":
            out[c] = 4
        elif x in string.ascii_uppercase:
            out[c] = 5
        elif x.isalpha():
            out[c] = 6
        elif x == "\n":
            out[c] = 8
        elif x.isspace():
            out[c] = 7
        elif x in _MARKS:
            out[c] = 9 + _MARKS.index(x)
    return out


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _class_table()[np.minimum(codes, 0x24F)]


def legal() -> np.ndarray:
    """legal[s, t]: whether tag t may follow tag s; the last row is for the start of a window."""
    ok = np.ones((N_TAGS + 1, N_TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    ok[N_TAGS, 2::2] = True  # a window may begin inside a span
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new_parameters(hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for side in "fb":
        p[f"x{side}"] = rng.normal(0, 0.2, (N_CLASSES, 4 * hidden))
        p[f"h{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)) * 0.7
        p[f"c{side}"] = np.zeros(4 * hidden)
        p[f"c{side}"][hidden : 2 * hidden] = 1.0
    p["out"] = rng.normal(0, 0.3, (2 * hidden, N_TAGS))
    p["bias"] = np.zeros(N_TAGS)
    p["bias"][0] = 1.0
    p["move"] = np.zeros((N_TAGS + 1, N_TAGS))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(x: np.ndarray, p: dict, side: str, keep: bool):
    """Hidden states (T, B, H) over classes x (T, B), from the front (f) or the back (b)."""
    steps, batch = x.shape
    hidden = p[f"h{side}"].shape[0]
    table, wh = p[f"x{side}"] + p[f"c{side}"], p[f"h{side}"]
    h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    out, saved = np.empty((steps, batch, hidden), np.float32), []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = table[x[t]] + h @ wh
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        before = (h, c)
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((t, before, i, f, o, g, tc))
    return out, saved


def _back(x: np.ndarray, p: dict, side: str, saved: list, dout: np.ndarray, grad: dict) -> None:
    batch, hidden = dout.shape[1:]
    wh = p[f"h{side}"]
    dx, dwh = np.zeros_like(p[f"x{side}"]), np.zeros_like(wh)
    dh, dc = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    for t, (h0, c0), i, f, o, g, tc in reversed(saved):
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate(
            [dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1
        )
        np.add.at(dx, x[t], dz)
        dwh += h0.T @ dz
        dh, dc = dz @ wh.T, dc * f
    grad[f"x{side}"], grad[f"h{side}"], grad[f"c{side}"] = dx, dwh, dx.sum(axis=0)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def _step(x: np.ndarray, y: np.ndarray, p: dict, own_share: float = 1.0) -> tuple[float, dict]:
    """Loss and gradients: the CRF's negative log likelihood of tags y (T, B), and own_share times that of each tag by its place's scores alone."""
    steps, batch = x.shape
    hf, sf = _run(x, p, "f", True)
    hb, sb = _run(x, p, "b", True)
    h = np.concatenate([hf, hb], axis=2)
    e = h @ p["out"] + p["bias"]
    move = np.where(legal(), p["move"], -1e4).astype(np.float32)
    a, first = move[:N_TAGS], move[N_TAGS]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = first + e[0]
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + a, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _log_sum(alpha[-1], 1)
    unary = np.exp(alpha + beta - z[:, None])
    pair = np.exp(alpha[:-1, :, :, None] + a + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum(axis=(0, 1))
    gold = np.eye(N_TAGS, dtype=np.float32)[y]
    own = np.exp(e - e.max(axis=2, keepdims=True))
    own /= own.sum(axis=2, keepdims=True)
    # The path's likelihood, and each place's own: so outside leads the inner tags too where none begins.
    de = (unary - gold + own_share * (own - gold)) / batch
    dmove = np.zeros_like(p["move"])
    dmove[:N_TAGS] = pair
    np.add.at(dmove, (y[:-1].ravel(), y[1:].ravel()), -1)
    dmove[N_TAGS] = (unary[0] - gold[0]).sum(axis=0)
    score = np.take_along_axis(e, y[:, :, None], 2).sum() + a[y[:-1], y[1:]].sum() + first[y[0]].sum()
    grad = {"out": np.einsum("tbh,tbk->hk", h, de), "bias": de.sum(axis=(0, 1)), "move": dmove / batch}
    dh = de @ p["out"].T
    hidden = hf.shape[2]
    _back(x, p, "f", sf, dh[:, :, :hidden], grad)
    _back(x, p, "b", sb, dh[:, :, hidden:], grad)
    lost = own_share * -np.log(np.take_along_axis(own, y[:, :, None], 2)).sum()
    return float(z.sum() - score + lost) / batch, grad


def _hidden(x: np.ndarray, p: dict) -> np.ndarray:
    """Hidden states (T, 2, B, n) of both directions at once, the second from the last place on: _run() without what training needs.

    In place, and with tanh(z) as 2 / (1 + exp(-2 z)) - 1, since NumPy's exp is much faster than its tanh.
    """
    steps, batch = x.shape
    n, classes = p["hf"].shape[0], len(p["xf"])
    # Directions and gates come first, so that each gate's numbers lie together.
    scale = np.array([-1, -1, -1, -2], np.float32)[:, None, None]
    gates = lambda v: v.reshape(len(v), 4, n).transpose(1, 0, 2) * scale
    table = np.concatenate([gates(p[f"x{side}"] + p[f"c{side}"]).reshape(-1, n) for side in "fb"])
    wh = np.stack([gates(p[f"h{side}"]) for side in "fb"])
    at = np.stack([x, x[::-1]], axis=1).astype(np.intp)[:, :, None] + (np.arange(8) * classes).reshape(2, 4, 1)
    h, c = np.zeros((2, batch, n), np.float32), np.zeros((2, batch, n), np.float32)
    z, gz, tc = np.empty((2, 4, batch, n), np.float32), np.empty((2, 4, batch, n), np.float32), np.empty((2, batch, n), np.float32)
    out = np.empty((steps, 2, batch, n), np.float32)

    def shares(v: np.ndarray) -> None:
        np.exp(v, out=v)
        v += 1
        np.reciprocal(v, out=v)

    with np.errstate(over="ignore"):
        for t in range(steps):
            np.matmul(h[:, None], wh, out=z)
            z += np.take(table, at[t], axis=0, out=gz, mode="clip")
            shares(z)
            g = z[:, 3]
            g *= 2
            g -= 1
            g *= z[:, 0]
            c *= z[:, 1]
            c += g
            np.multiply(c, -2, out=tc)
            shares(tc)
            tc *= 2
            tc -= 1
            h = out[t]
            np.multiply(z[:, 2], tc, out=h)
    return out


def scores(x: np.ndarray, p: dict) -> np.ndarray:
    """Scores (B, T, N_TAGS) of every tag at every place of windows of classes x (B, T)."""
    found, n = _hidden(np.ascontiguousarray(x.T), p), p["hf"].shape[0]
    out = found[:, 0] @ p["out"][:n] + found[::-1, 1] @ p["out"][n:] + p["bias"]
    return out.transpose(1, 0, 2)


def transitions(p: dict) -> np.ndarray:
    return np.where(legal(), p["move"], -1e4).astype(np.float32)


def best_path(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Tags (B, T) of the best paths over scores e (B, T, N_TAGS), from outside and to outside (Viterbi)."""
    e = e.transpose(1, 0, 2)
    steps, batch, _ = e.shape
    move = move[:N_TAGS]
    into = np.ascontiguousarray(move.T)  # into[t, s]
    score, back = move[0] + e[0], np.empty((steps, batch, N_TAGS), np.int8)
    for t in range(1, steps):
        s = score[:, None, :] + into
        back[t] = s.argmax(axis=2)
        score = s.max(axis=2) + e[t]
    tags = np.empty((steps, batch), np.int8)
    tags[-1] = (score + move[:, 0]).argmax(axis=1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = back[t][rows, tags[t]]
    return tags.T


def certainty(p: dict) -> tuple[float, int]:
    """(lead, reach): a place that is `reach` places inside a run where outside leads every tag by `lead`
    is outside on the best path.

    A span of n places in such a run costs n leads and n + 1 transitions: twice the range of the
    transitions is lead enough. A span that runs into the run from a place beyond it has at least
    `reach` places in it; cutting them off may turn one inner tag beyond into a beginning.
    """
    free = p["move"][:N_TAGS][legal()[:N_TAGS]]
    span = float(free.max() - free.min())
    turn = max(float(np.abs(p["out"][:, k] - p["out"][:, k + 1]).sum() + abs(p["bias"][k] - p["bias"][k + 1])) for k in range(1, N_TAGS, 2))
    lead = 2 * span + 0.1
    return lead, int(np.ceil((turn + 2 * span) / (lead - span))) + 1


class Examples:
    """Labelled text made from a seed: pseudo-words with personal data and look-alikes among them."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self._text: tuple[np.ndarray, np.ndarray] | None = None

    def digits(self, n: int) -> str:
        return "".join(self.r.choices(string.digits, k=n))

    def name(self, low: int, high: int, letters: str = string.ascii_lowercase) -> str:
        return "".join(self.r.choices(letters, k=self.r.randint(low, high)))

    def email(self) -> str:
        r = self.r
        local = self.name(2, 10) + r.choice(["", ".", "_", "-", "+"]) * r.randint(0, 1)
        local += r.choice([self.digits(2), self.name(2, 8), "", self.digits(r.randint(1, 4))])
        if not local[-1].isalnum():
            local += self.name(1, 3)
        if r.random() < 0.2:
            local = local.title()
        host = self.name(2, 9) + r.choice(["", self.digits(1), "-" + self.name(2, 5)])
        return f"{local}@{host}." + r.choice(["com", "org", "de", "example.com", "co.uk", "net", "fr", "example.org"])

    def ip(self) -> str:
        return ".".join(str(self.r.randint(0, 255)) for _ in range(4))

    def card(self) -> str:
        d = self.digits(self.r.choice([16, 16, 16, 16, 15, 14, 13, 19]) - 1)
        total = sum(x if k % 2 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d))))
        d += str(-total % 10)  # Luhn's check digit
        sep = self.r.choice(["", "", "", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d

    def phone(self) -> str:
        r, d = self.r, self.digits
        return r.choice(
            [
                f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(r.randint(1, 3))} {d(3)} {d(3)} {d(4)}",
                f"+{d(r.randint(10, 13))}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(4)} {d(6)}",
                f"+{d(2)}-{d(3)}-{d(7)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1.{d(3)}.{d(3)}.{d(4)}",
            ]
        )

    def other(self) -> str:
        r, d = self.r, self.digits
        hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
        return r.choice(
            [
                f"password={hexes(18)}", f'token = "{hexes(40)}"', "AKIA" + "".join(r.choices(string.ascii_uppercase + string.digits, k=16)),
                f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.", d(r.randint(1, 8)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}",
                f"${d(2)}.{d(2)}", f"{d(3)},{d(3)}", hexes(r.choice([8, 16, 32])), d(r.randint(21, 30)), f"@{self.name(3, 9)}", f"{d(2)}%",
                f"({d(4)})", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f"v{d(1)}.{d(2)}.{d(1)}", f"no. {d(2)}", f"{self.name(2, 5)}{d(3)}",
            ]
        )

    def filler(self) -> str:
        r = self.r
        word = self.name(1, 11, string.ascii_lowercase + "eeaaiinntt" + r.choice(["", "éèçñüöäß"]))
        if r.random() < 0.12:
            word = word.capitalize()
        elif r.random() < 0.03:
            word = word.upper()
        return word + r.choice([""] * 12 + [",", ".", ".", " |", "!!", "***", ":", ";", "?"])

    def document(self, size: int) -> tuple[str, list[int]]:
        """A text of at least size characters and its tags."""
        r, parts, tags, n = self.r, [], [], 0
        while n < size:
            pick = r.random()
            if pick < 0.30:
                kind = r.randrange(len(KINDS))
                piece = getattr(self, KINDS[kind])()
                own = [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
                if r.random() < 0.1:
                    piece, own = piece + r.choice(",.;)"), [*own, 0]
            else:
                piece = self.other() if pick < 0.45 else self.filler()
                own = [0] * len(piece)
            parts += [piece, r.choice("\n" + " " * 14)]
            tags += own + [0]
            n += len(piece) + 1
        return "".join(parts), tags

    def labelled(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes and tags of document(size)."""
        text, tags = self.document(size)
        return classes(text), np.array(tags, np.int8)

    def window(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes and tags of size characters, cut at a random place of a text made once."""
        r = self.r
        if self._text is None:
            self._text = self.labelled(POOL)
        at = r.randint(0, len(self._text[0]) - size)
        x, y = (a[at : at + size].copy() for a in self._text)
        if r.random() < 0.3:  # the text begins or ends inside the window, as often as not with a span
            ends = np.flatnonzero((y[1:] == 0) & (y[:-1] != 0)) + 1
            starts = np.flatnonzero(y[1:] % 2 == 1) + 1
            if len(ends) and r.random() < 0.6:
                i = r.choice(ends.tolist())
                x[i:], y[i:] = 0, 0
            elif len(starts):
                i = r.choice(starts.tolist())
                x[:i], y[:i] = 0, 0
        return x, y

    def batch(self, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.window(size) for _ in range(n)]
        return np.stack([a for a, _ in rows], 1), np.stack([b for _, b in rows], 1)


@functools.cache
def trained(hidden: int = 8, steps: int = 900, batch: int = 48, size: int = 72, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters after Adam steps on labelled spans; the same for equal arguments."""
    p, made = new_parameters(hidden, seed), Examples(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    for t in range(1, steps + 1):
        x, y = made.batch(batch, size)
        _, grad = _step(x, y.astype(np.int64), p)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / norm)
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        # Transitions of a narrow range: places in plain text are then certain by their scores (certainty()).
        p["move"] = np.clip(p["move"], -MOVE, MOVE)
    return p
