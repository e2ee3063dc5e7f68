"""Trains the markup labeller on texts made here: python -m citeloom.llm.markup_training.

Texts are put together from invented words in each notation, in mixtures and as prose
with signs that only resemble markup. The pieces know what they are, so every leaf of the
scanner gets its label from the piece it starts in. DOCUMENTS bounds the sample.
"""

from __future__ import annotations

import random

import numpy as np

from citeloom.llm.markup import CODE, FEATURES, FORMULA, HEADING, LIST, MARKUP, PROSE, WEIGHTS, Labeller, leaves, unescaped, vectors

DOCUMENTS, HIDDEN, EPOCHS, BATCH, RATE = 24_000, 20, 10, 48, 4e-3
SYLLABLES = "ba be bi bo bu da de di do du fa fe ga go ka ke ki la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se si so ta te ti to va ve vi zo".split()
Piece = tuple[str, int]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        w = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))
        return w.capitalize() if self.r.random() < 0.12 else w

    def words(self, lo: int, hi: int) -> str:
        out = [self.number() if self.r.random() < 0.07 else self.word() for _ in range(self.r.randint(lo, hi))]
        return " ".join(out)

    def number(self) -> str:
        n = self.r.randint(1, 9999)
        return self.r.choice([str(n), f"{n / 100:.2f}", f"{n:,}", str(n % 30)])

    def math(self) -> str:
        v = lambda: self.r.choice("abcijkmnpqrstuvxyzLOH")
        g = lambda: "\\" + self.r.choice("alpha beta gamma lambda mu sigma theta omega delta pi".split())
        return self.r.choice([
            lambda: f"{v()}^{self.r.randint(2, 9)} + {v()}^2 = {v()}^2", lambda: f"\\frac{{{v()}}}{{{v()}}}", lambda: f"\\sum_{{{v()}=1}}^{{{v()}}} {v()}_{v()}",
            lambda: f"p({v()} \\mid {v()}) = 0.{self.r.randint(1, 9)}", lambda: f"{g()}_{{{v()}}} \\le {g()}", v, lambda: f"{v()}_{self.r.randint(1, 9)}", g,
            lambda: f"{v().upper()}({v()} \\log {v()})", lambda: f"\\mathrm{{{v().upper()}_{self.r.randint(1, 9)}{v().upper()}}}", lambda: f"{v()} = {self.number()}", lambda: f"{v()}+{v()}", lambda: f"{v()} < {self.number()}",
        ])()

    def code(self) -> str:
        return self.r.choice([
            lambda: f"SELECT {self.word()} FROM {self.word()} LIMIT {self.r.randint(1, 99)}", lambda: f"for {self.word()} in {self.word()}:\n    print({self.word()}.{self.word()})  # {self.r.randint(1, 99)}",
            lambda: f"{self.word()}({self.word()}, {self.word()}={self.r.randint(1, 99)})", lambda: f"{self.word()} = [{self.word()}]\n* {self.word()}\nreturn {self.word()}", lambda: f"# {self.word()}\n$ {self.word()} --{self.word()} '{self.word()}'",
        ])()

    def lookalike(self) -> str:
        """Prose with signs that resemble markup."""
        w, n, r = self.word, self.number, self.r
        return r.choice([
            lambda: f"{w()} {w()} {w()}: * {w()} {n()} {w()} ** {w()} {n()}", lambda: f"{w()} {w()} ${n()} {w()} ${n()} {w()} {w()}", lambda: f"{w()} {w()} ${n()}, {w()} {w()} ${n()} {w()}", lambda: f"{w()} ${n()} {w()} {w()}",
            lambda: f"{w()} #{r.randint(1, 99)} {w()} {w()}", lambda: f"{w()} {w()} {{{r.randint(1, 99)}, {r.randint(1, 99)}, {r.randint(1, 99)}}} {w()} {w()}", lambda: f"{w()} {{{n()} {n()} {n()}}} {w()}", lambda: f"{w()} {{{r.randint(0, 9)}, {r.randint(0, 9)}}} {w()}",
            lambda: f"{w()} a < b {w()} c > d {w()}", lambda: f"{w()} n > {n()} {w()} n < {n()}", lambda: f"{w()} {w()}_{w()}_{w()} {w()}", lambda: f"{w()} _{w()} {w()}", lambda: f"{w()} {n()} * {n()} * {n()} {w()}",
            lambda: f"{w()} C++ {w()} C# {w()} R&D {w()}", lambda: f"{w()} A*-{w()} {w()}", lambda: f"{w()} & {w()}", lambda: f"{w()} [{r.randint(1, 99)}] {w()} [{r.randint(1, 99)}] {w()}", lambda: f"{w()} p < 0.0{r.randint(1, 9)}", lambda: f"{w()} (p = {n()}, n = {n()}) {w()}",
            lambda: f"{w()} x = {n()} {w()} y ^ {n()}", lambda: f"{w()}.[{r.randint(1, 99)},{r.randint(1, 99)}] {w()}", lambda: f"{w()} {w()} | {w()}", lambda: f'"{w()} {w()}," {w()} {w()}',
        ])()

    def sentence(self, signs: float = 0.1) -> list[Piece]:
        out = self.lookalike() if self.r.random() < signs else self.words(3, 12)
        return [(out[:1].upper() + out[1:], PROSE), (self.r.choice([". ", ". ", ".", "! ", "? ", "... ", " "]), PROSE)]

    # inline markup of each notation
    def inline(self, kind: str) -> list[Piece]:
        w, r = self.word(), self.r
        text = w + r.choice(["", "", ".", ","])
        if kind == "tex":
            return r.choice([
                [(f"\\{r.choice('emph textbf textit textsc texttt underline href url mbox'.split())}", MARKUP), ("{", MARKUP), (text + "}", PROSE)], [("{", MARKUP), (f"\\{r.choice('em it bf sc tt'.split())}", MARKUP), (f" {text}}}", PROSE)], [(f"``{text}''", MARKUP)],
                [("{", MARKUP), (w + "}", PROSE)], [("{", MARKUP), ("{", MARKUP), (w + "}}", PROSE)], [("~", MARKUP), (w, PROSE)], [("\\" + r.choice("%$&_#,;"), MARKUP), (w, PROSE)], [(self.number(), PROSE), ("\\%", MARKUP)], [("\\$", MARKUP), (self.number(), PROSE)],
                [(f"\\{r.choice('cite citep citet ref footnote label'.split())}", MARKUP), ("{", MARKUP), (f"{w}}}", PROSE)], [("\\citep", MARKUP), (r.choice(["[see][]", "[p.]"]), MARKUP), ("{", MARKUP), (w + "}", PROSE)], [("\\footnotemark", MARKUP), ("{", MARKUP), ("}", PROSE)], [("\\'", MARKUP), ("e" + w, PROSE)], [('\\"', MARKUP), ("{", MARKUP), ("o}" + w, PROSE)],
                [("\\href", MARKUP), ("{", MARKUP), ("https://x.example/a}", PROSE), ("{", MARKUP), (text + "}", PROSE)], [("{", MARKUP), (r.choice(["=", self.number(), w.upper(), f"({w}", self.words(2, 6)]) + "}", PROSE)],
            ])
        if kind == "md":
            return [r.choice([(f"*{text}*", MARKUP), (f"**{text}**", MARKUP), (f"***{text}***", MARKUP), (f"__{text}__", MARKUP), (f"_{w}_", MARKUP), (f"~~{text}~~", MARKUP), (f"[{text}](https://x.example/{w})", MARKUP), (f"[{text}][{r.randint(1, 9)}]", MARKUP), (f"`{w}`", MARKUP), (f"**{r.choice(['=', self.number()])}**", MARKUP), (f"__{self.number()}__", MARKUP), (f"*{self.number()}*", MARKUP), (f"[{self.number()}](https://x.example/a)", MARKUP)])]
        if kind == "wiki":
            return [r.choice([(f"''{text}''", MARKUP), (f"'''{text}'''", MARKUP), (f"[[{text}]]", MARKUP), (f"[[{self.words(1, 2)}|{text}]]", MARKUP), (f"{{{{{w}|{w}}}}}", MARKUP), ("<ref name=a />", MARKUP), ("<br />", MARKUP), (f"<ref>{w}</ref>", MARKUP)])]
        if r.random() < 0.3:
            return [(r.choice(["&nbsp;", "&#8201;", "&#x2013;", "&amp;", "&lt;", "&ldquo;", "&rdquo;", "&eacute;", "&mdash;", "&thinsp;"]), MARKUP), (r.choice(["", w]), PROSE)]
        if r.random() < 0.1:
            return [(f"<!-- {w} -->", MARKUP)]
        if r.random() < 0.1:
            return [(r.choice(["<br/>", "<br>", "<BR>", "<hr/>"]), MARKUP)]
        p = "jats:" if kind == "jats" and r.random() < 0.8 else ""
        name = r.choice("italic bold sup sub sc xref ext-link".split() if kind == "jats" else "i b em strong sub sup a span SPAN u code scp small".split())
        extra = r.choice(["", "", "", ' rid="r1"', " class=hl", ' href="https://x.example/?id=1"'])
        return [(f"<{p}{name}{extra}>", MARKUP), (text, PROSE), (f"</{p}{name}>", MARKUP)]

    def paragraph(self, kind: str, rate: float = 0.5) -> list[Piece]:
        out: list[Piece] = []
        for _ in range(self.r.randint(1, 3)):
            if self.r.random() < rate:
                out += [(self.words(1, 4) + self.r.choice([" ", " ", "-"]), PROSE), *self.inline(kind), (self.r.choice([" ", "-", ""]), PROSE)]
            out += self.sentence(0.06)
        if self.r.random() < 0.4:
            out += [(self.words(1, 4) + " ", PROSE), *self.inline(kind), (self.r.choice(["", "", "."]), PROSE)]
        return [*self.inline(kind), (" ", PROSE), *out] if self.r.random() < 0.3 else out

    def formula(self, kind: str) -> Piece:
        m, r = self.math(), self.r
        if kind == "tex":
            return (r.choice([f"${m}$", f"\\({m}\\)", f"\\[{m}\\]", f"$${m}$$", f"\\begin{{equation}}\n{m}\n\\end{{equation}}", f"\\ensuremath{{{m}}}", f"\\begin{{align*}}{m}\\end{{align*}}"]), FORMULA)
        if kind == "md":
            return (r.choice([f"${m}$", f"$${m}$$"]), FORMULA)
        if kind == "wiki":
            return (f"<math>{m}</math>", FORMULA)
        if kind == "html":
            return (r.choice([f"<math><mtext>{m}</mtext></math>", f"<math>{m}</math>", f"<math><mi>{m}</mi></math>", f"\\({m}\\)"]), FORMULA)
        return (r.choice([f"<jats:inline-formula><jats:tex-math>{m}</jats:tex-math></jats:inline-formula>", f"<jats:disp-formula>{m}</jats:disp-formula>", f"<inline-formula>{m}</inline-formula>", f"<mml:math>{m}</mml:math>"]), FORMULA)

    def block(self, kind: str) -> list[Piece]:
        r, what = self.r, self.r.random()
        if what < 0.2:
            t = self.words(1, 4)
            if kind == "tex":
                return [(f"\\{r.choice('section subsection subsubsection paragraph'.split())}{r.choice(['', '*'])}{{{t}}}", HEADING)]
            if kind == "md":
                return [(r.choice([f"{'#' * r.randint(1, 5)} {t}", f"{t}\n{'=' * r.randint(3, 9)}", f"{t}\n{'-' * r.randint(3, 9)}"]), HEADING)]
            if kind == "wiki":
                e = "=" * r.randint(1, 4)
                return [(f"{e} {t} {e}", HEADING)]
            tag = "jats:title" if kind == "jats" else r.choice(["h1", "h2", "h3", "h4", "h5", "H2"])
            return [(f"<{tag}>", HEADING), (t, PROSE), (f"</{tag}>", MARKUP)]
        if what < 0.35:
            items = [self.words(4, 12) if r.random() < 0.85 else self.lookalike() for _ in range(r.randint(1, 4))]
            out: list[Piece] = []
            if kind == "tex":
                env = r.choice(["itemize", "enumerate"])
                out.append((f"\\begin{{{env}}}", MARKUP))
                for i in items:
                    out += [("\n", PROSE), ("\\item", LIST), (" " + i, PROSE)]
                return [*out, ("\n", PROSE), (f"\\end{{{env}}}", MARKUP)]
            if kind in ("md", "wiki"):
                sign = r.choice(["- ", "* ", "+ ", "1."] if kind == "md" else ["* ", "# ", "** ", "* "])
                for n, i in enumerate(items, 1):
                    if sign == "# ":
                        out += [("\n" * (n > 1), PROSE), (f"# {i}", LIST)]
                    else:
                        out += [("\n" * (n > 1), PROSE), (f"{n}. " if sign == "1." else sign, LIST), (i, PROSE)]
                return out
            if kind == "jats":
                out.append(("<jats:list>", MARKUP))
                for i in items:
                    out += [("<jats:list-item>", LIST), ("<jats:p>", MARKUP), (i, PROSE), ("</jats:p>", MARKUP), ("</jats:list-item>", MARKUP)]
                return [*out, ("</jats:list>", MARKUP)]
            ul, open_ = r.choice(["ul", "ol", "UL"]), r.random() < 0.4
            out.append((f"<{ul}>", MARKUP))
            for i in items:
                out += [("<li>", LIST), (i, PROSE), *([] if open_ else [("</li>", MARKUP)])]
            return [*out, *([("\n", PROSE)] if open_ else []), (f"</{ul}>", MARKUP)]
        if what < 0.47:
            c = self.code()
            if kind == "tex":
                env = r.choice(["verbatim", "lstlisting"])
                return [(f"\\begin{{{env}}}\n{c}\n\\end{{{env}}}", CODE)]
            if kind == "md":
                return [(f"```{r.choice(['', 'python', 'sql'])}\n{c}\n```", CODE)]
            if kind == "wiki":
                return [(r.choice([f"<syntaxhighlight>{c}</syntaxhighlight>", f'<syntaxhighlight lang="sql">\n{c}\n</syntaxhighlight>', f"<pre>{c}</pre>", f"<source>{c}</source>"]), CODE)]
            return [(r.choice([f"<jats:preformat>{c}</jats:preformat>", f"<jats:code>{c}</jats:code>", f"<preformat>{c}</preformat>"]) if kind == "jats" else r.choice([f"<pre><code>{c}</code></pre>", f"<pre>{c}</pre>"]), CODE)]
        if what < 0.6:
            return [*self.sentence(0), (r.choice([": ", ", where ", " "]), PROSE), self.formula(kind), (r.choice([" holds.", ".", "-" + self.word(), " " + self.word()]), PROSE)]
        body = self.paragraph(kind)
        if kind == "jats":
            return [("<jats:p>", MARKUP), *body, ("</jats:p>", MARKUP)]
        if kind == "html":
            tag, attr = r.choice([("p", ""), ("p", ""), ("div", " class='a'")])
            return [(f"<{tag}{attr}>", MARKUP), *body, *([] if tag == "p" and r.random() < 0.3 else [(f"</{tag}>", MARKUP)])]
        return body

    def document(self) -> list[Piece]:
        r = self.r
        what = r.random()
        if what < 0.22:  # prose alone, rich in signs
            return [p for _ in range(r.randint(1, 5)) for p in self.sentence(0.6)]
        if what < 0.4:  # a title or one sentence with one piece of markup
            kind = r.choice("tex tex md wiki html jats".split())
            out: list[Piece] = [(self.words(1, 4) + r.choice([" ", " ", "-"]), PROSE)] if r.random() < 0.8 else []
            inner = [self.formula("tex")] if r.random() < 0.3 else self.inline(kind)
            out = [*out, *inner, (r.choice([" ", "-", ": "]) + self.words(1, 5), PROSE)] if r.random() < 0.75 else [*out, *inner]
            if r.random() < 0.35:
                out.append((" " + self.lookalike(), PROSE))
            if r.random() < 0.2:
                out = [("{", MARKUP), *out, ("}", PROSE)]
            return out
        kind = r.choice("tex md wiki html jats".split())
        gap = {"md": "\n\n", "tex": "\n", "wiki": "\n"}.get(kind) or r.choice(["", " ", "\n"])
        out = []
        for _ in range(r.randint(1, 7)):
            b = self.block(kind)
            if out:
                out.append((gap, PROSE))
            out += b
        return out


def sample(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and labels of n made documents."""
    m, xs, ys = Maker(seed), [], []
    while len(xs) < n:
        text, kinds = "", []
        for piece, label in m.document():
            kinds += [label] * len(piece)
            text += piece
        if unescaped(text) != text:
            continue
        seq = leaves(text)
        if seq:
            xs.append(vectors(text, seq))
            ys.append(np.array([PROSE if x.kind == "text" else kinds[x.start] for x in seq]))
    return xs, ys


def train(documents: int = DOCUMENTS, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights after gradient descent with Adam through the whole sequences."""
    xs, ys = sample(documents, seed)
    rng, size = np.random.default_rng(seed), HIDDEN
    p: dict[str, np.ndarray] = {}
    for side in "fb":
        p[f"{side}_wx"] = rng.normal(0, 0.1, (FEATURES, 4 * size))
        p[f"{side}_wh"] = rng.normal(0, 0.1, (size, 4 * size))
        p[f"{side}_b"] = np.concatenate([np.zeros(size), np.ones(size), np.zeros(2 * size)])
    p["out_w"], p["out_b"] = rng.normal(0, 0.1, (2 * size + FEATURES, 6)), np.zeros(6)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    order = sorted(range(len(xs)), key=lambda k: len(xs[k]))
    batches = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
    for epoch in range(epochs):
        rng.shuffle(batches)
        total = wrong = seen = 0
        for batch in batches:
            t = max(len(xs[k]) for k in batch)
            x = np.zeros((len(batch), t, FEATURES))
            y = np.full((len(batch), t), -1)
            for r, k in enumerate(batch):
                x[r, : len(xs[k])], y[r, : len(ys[k])] = xs[k], ys[k]
            mask = y >= 0
            grad: dict[str, np.ndarray] = {}
            hs, tapes = [], []
            for side in "fb":
                h, tape = _forward(p, x, mask, side)
                hs.append(h)
                tapes.append(tape)
            top = np.concatenate([*hs, x], axis=2)
            z = top @ p["out_w"] + p["out_b"]
            z -= z.max(2, keepdims=True)
            q = np.exp(z)
            q /= q.sum(2, keepdims=True)
            hit = np.take_along_axis(q, np.maximum(y, 0)[..., None], 2)[..., 0]
            total += -np.log(hit[mask] + 1e-9).sum()
            wrong += (q.argmax(2) != y)[mask].sum()
            seen += mask.sum()
            d = q
            np.put_along_axis(d, np.maximum(y, 0)[..., None], hit[..., None] - 1, 2)
            d = d * mask[..., None] / mask.sum()
            grad["out_w"] = np.einsum("nti,ntj->ij", top, d)
            grad["out_b"] = d.sum((0, 1))
            back = d @ p["out_w"].T
            for side, at, tape in zip("fb", (0, size), tapes):
                _backward(p, grad, x, back[..., at : at + size], tape, side)
            step += 1
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch + 1}: loss {total / seen:.5f}, wrong {wrong} of {seen}", flush=True)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(p: dict, x: np.ndarray, mask: np.ndarray, side: str) -> tuple[np.ndarray, list]:
    wx, wh, b = (p[f"{side}_{k}"] for k in ("wx", "wh", "b"))
    n, t, _ = x.shape
    size = wh.shape[0]
    z_all = x @ wx + b
    h = c = np.zeros((n, size))
    out, tape = np.zeros((n, t, size)), []
    for k in range(t) if side == "f" else range(t - 1, -1, -1):
        z = z_all[:, k] + h @ wh
        g = 1 / (1 + np.exp(-z[:, : 3 * size]))
        i, f, o, u = g[:, :size], g[:, size : 2 * size], g[:, 2 * size :], np.tanh(z[:, 3 * size :])
        m = mask[:, k, None]
        c2 = np.where(m, f * c + i * u, c)
        h2 = np.where(m, o * np.tanh(c2), h)
        tape.append((k, h, c, i, f, o, u, c2, m))
        h, c = h2, c2
        out[:, k] = h
    return out, tape


def _backward(p: dict, grad: dict, x: np.ndarray, d_out: np.ndarray, tape: list, side: str) -> None:
    wh = p[f"{side}_wh"]
    n, t, _ = x.shape
    dz_all = np.zeros((n, t, 4 * wh.shape[0]))
    dwh = np.zeros_like(wh)
    dh = dc = np.zeros((n, wh.shape[0]))
    for k, h, c, i, f, o, u, c2, m in reversed(tape):
        total = dh + d_out[:, k]
        th = np.tanh(c2)
        dh_live = np.where(m, total, 0)
        dc_live = np.where(m, dc, 0) + dh_live * o * (1 - th * th)
        dz = np.concatenate([dc_live * u * i * (1 - i), dc_live * c * f * (1 - f), dh_live * th * o * (1 - o), dc_live * i * (1 - u * u)], axis=1)
        dz_all[:, k] = dz
        dwh += h.T @ dz
        dh = dz @ wh.T + np.where(m, 0, total)
        dc = dc_live * f + np.where(m, 0, dc)
    grad[f"{side}_wh"] = dwh
    grad[f"{side}_wx"] = np.einsum("nti,ntj->ij", x, dz_all)
    grad[f"{side}_b"] = dz_all.sum((0, 1))


def accuracy(weights: dict[str, np.ndarray], n: int = 2000, seed: int = 99) -> float:
    """Share of leaves labelled right in made documents that training has not seen."""
    xs, ys = sample(n, seed)
    got = Labeller(weights).label(xs)
    return sum((a == b).sum() for a, b in zip(got, ys)) / sum(map(len, ys))


if __name__ == "__main__":
    w = train()
    print("held-out accuracy", accuracy(w))
    np.savez_compressed(WEIGHTS, **w)
