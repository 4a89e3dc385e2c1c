"""Main text of web pages by a recurrent block labeller.

A bidirectional LSTM in numpy reads a page's blocks in order, each as a vector of hashed tag-path features,
hashed words and a few measures, and labels every block as main text or not with the whole page in view.

The labeller is trained on pages made by sample_page(), whose labels are known: layouts, class names, words and
nesting vary at random. Training is seeded and takes seconds on the driver; the weights are sent to executors.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .html_blocks import Block, Path, blocks

#: Buckets of path features and of words, further measures, units of each direction.
PATHS, WORDS, MEASURES, UNITS = 256, 64, 6, 16
SIZE = PATHS + WORDS + MEASURES
#: Pages, rounds and seed of the training, pages labelled at a time, blocks of a page that are held as features.
PAGES, ROUNDS, SEED, AT_ONCE, LONG = 700, 10, 5, 256, 20_000

#: Names by which pages mark parts that aren't main text, with words found there.
ASIDES = {
    "nav": (["nav", "navbar", "menu", "navigation", "topnav", "breadcrumb", "breadcrumbs", "toc"], ["home", "about", "contact", "menu", "login", "search"]),
    "header": (["header", "masthead", "topbar", "site header", "logo", "branding", "page header", "banner"], ["welcome", "site", "official", "menu"]),
    "footer": (["footer", "bottom", "copyright", "site footer", "colophon", "legal", "credits"], ["©", "copyright", "rights", "reserved", "privacy", "terms", "·"]),
    "aside": (["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "more stories", "aside", "rail", "teaser"], ["related", "popular", "recent", "more", "read"]),
    "ad": (["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "ad slot", "sponsor", "commercial", "adsense", "banner ad"], ["sponsored", "advertisement", "buy", "offer", "now", "free"]),
    "notice": (["cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "cookie banner", "cookie notice", "privacy notice", "paywall"], ["cookies", "accept", "consent", "privacy", "agree", "policy"]),
    "form": (["form", "newsletter", "subscribe", "signup", "login", "search", "search form", "contact form", "register"], ["email", "subscribe", "sign", "up", "submit", "name", "password", "send"]),
    "comments": (["comments", "comment", "discussion", "replies", "respond", "disqus", "comment list", "reader comments", "user comment", "feedback", "responses"], ["reply", "comments", "said", "says", "wrote", "ago", "report"]),
    "share": (["share", "social", "sharing", "share buttons", "follow", "tags", "pagination", "pager", "author bio", "meta", "byline"], ["share", "tweet", "follow", "facebook", "next", "previous", "tags"]),
}
MAIN_NAMES = ["content", "main", "article", "post", "entry", "story", "body", "text", "article body", "post content", "entry content", "main content", "page content", "story body", "articlebody"]


def _words(rng: random.Random, n: int) -> str:
    parts = ["an", "er", "on", "the", "re", "in", "es", "qu", "el", "de", "la", "sch", "ung", "ción", "é", "tion", "ou", "ar", "st", "mi"]
    out = ["".join(rng.choices(parts, k=rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(n)]
    style = rng.random()
    if style < 0.06:
        out = [w.upper() + "!!" for w in out]
    elif style < 0.12:
        out = [w + rng.choice(["***", "$$$", "###", "&&&"]) for w in out]
    elif style < 0.18:
        out = [w + " |" for w in out]
    elif style < 0.22:
        out = out[:1] * n
    return " ".join(out).capitalize() if rng.random() < 0.8 else " ".join(out)


def sample_page(rng: random.Random) -> tuple[list[Block], list[int]]:
    """The blocks of a made-up page, and 1 for those of its main text."""
    out: list[tuple[Block, int]] = []
    names = lambda x: tuple(rng.choice(x).split(" "))
    shell = [("html", ()), ("body", ())] if rng.random() < 0.9 else []
    shell = shell + [("div", names([*["wrapper", "page", "container", "site", "app", "root"], ""]))] if rng.random() < 0.4 else shell

    def aside(kind: str, around: list) -> None:
        classes, words = ASIDES[kind]
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        semantic = rng.random() < 0.6
        tag = tag if semantic else rng.choice(["div", "div", "section", "ul"])
        box = [*around, (tag, names(classes) if not semantic or kind in ("ad", "notice", "comments", "share") or rng.random() < 0.4 else ())]
        if rng.random() < 0.3:
            box.append((rng.choice(["div", "section"]), names([*classes, "inner", "row"])))
        many = {"nav": (3, 10), "aside": (1, 8), "comments": (1, 8), "form": (1, 4), "share": (1, 4)}.get(kind, (1, 2))
        for _ in range(rng.randint(*many)):
            path, linked = list(box), 0.0
            if kind == "nav" or kind in ("aside", "share", "header") and rng.random() < 0.5:
                path += [("ul", ()), ("li", ()), ("a", ())] if rng.random() < 0.7 else [("a", ())]
                linked, text = 1.0, _words(rng, rng.randint(1, 3))
            elif kind == "comments":
                path += rng.choice([[("p", ())], [("div", ("comment",)), ("p", ())], [("ol", ()), ("li", ("comment",)), ("p", ())], [("div", ("comment",))]])
                text = _words(rng, rng.randint(2, 60))
            elif kind == "form":
                path += rng.choice([[("label", ())], [("button", ())], [("p", ())], []])
                text = _words(rng, rng.randint(1, 12))
            else:
                path += rng.choice([[], [], [("p", ())], [("h3", ())], [("span", ())]])
                text = _words(rng, rng.randint(2, 25))
            if rng.random() < 0.35:
                text += " " + " ".join(rng.choices(words, k=rng.randint(1, 3)))
            out.append((Block(Path.of(path), text, int(len(text) * linked)), 0))

    for kind, chance in (("notice", 0.25), ("header", 0.4), ("nav", 0.75), ("ad", 0.5), ("form", 0.15), ("aside", 0.2), ("share", 0.1)):
        if rng.random() < chance:
            aside(kind, shell)
    style, core = rng.random(), list(shell)
    if style < 0.5:
        core.append(("article", names([*MAIN_NAMES, ""]) if rng.random() < 0.3 else ()))
    elif style < 0.7:
        core.append(("main", ()))
        core += [("article", ())] if rng.random() < 0.4 else []
    elif style < 0.95:
        core.append((rng.choice(["div", "section", "td"]), names(MAIN_NAMES)))
    if rng.random() < 0.25:
        core.append(("div", names(MAIN_NAMES)))
    if rng.random() < 0.7:
        out.append((Block(Path.of((*core, *([("header", ())] if rng.random() < 0.1 and style < 0.5 else []), (rng.choice(["h1", "h1", "h2"]), ()))), _words(rng, rng.randint(1, 12))), 1))
    for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 30])):
        if rng.random() < 0.06:
            aside(rng.choice(["ad", "aside", "share", "form", "notice"]), core)
        leaf = rng.choice([[("p", ())]] * 8 + [[("p", ()), ("b", ())]] * 3 + [[("h2", ())], [("blockquote", ()), ("p", ())], [("ul", ()), ("li", ())], [("ol", ()), ("li", ())], [("pre", ())], [("div", ())], [], [("table", ()), ("tr", ()), ("td", ())]])
        text = _words(rng, rng.choice([1, 2, 3, 6, 12, 30, 60, 120]))
        out.append((Block(Path.of((*core, *leaf)), text, int(len(text) * rng.random() * 0.3) if rng.random() < 0.15 else 0), 1))
    for kind, chance in (("share", 0.2), ("ad", 0.2), ("comments", 0.3), ("form", 0.15), ("aside", 0.25), ("notice", 0.1), ("footer", 0.8)):
        if rng.random() < chance:
            aside(kind, core if kind in ("share", "comments") and rng.random() < 0.4 else shell)
    return [b for b, _ in out], [y for _, y in out]


@lru_cache(maxsize=1 << 16)
def _at(feature: str, size: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % size


def _mask(path: Path | None) -> int:
    """The features of a tag path as bits: its tags and all names, and the innermost two tags by their depth."""
    todo, at = [], path
    while at and at.mask is None:
        todo.append(at)
        at = at.parent
    bits = at.mask if at else 0
    for at in reversed(todo):
        for f in (f"t {at.tag}", *(f"n {name}" for name in at.names)):
            bits |= 1 << _at(f, PATHS)
        at.mask = bits
    for depth, at in enumerate((path, path.parent) if path else ()):
        bits |= 1 << _at(f"l{depth} {at.tag}", PATHS) if at else 0
    return bits


def features(page: list[Block], start: int = 0, stop: int | None = None, before: int = 0, total: int | None = None) -> np.ndarray:
    """A row for each block of a page, or of those from start to stop: before counts the characters of the blocks before them, total those of all."""
    part = page[start:stop]
    x = np.zeros((len(part), SIZE), np.float32)
    total = max(1, sum(len(b.text) for b in page)) if total is None else total
    for i, b in enumerate(part):
        x[i, :PATHS] = np.unpackbits(np.frombuffer(_mask(b.path).to_bytes(PATHS // 8, "little"), np.uint8), bitorder="little")
        words = b.text.lower().split()
        x[i, PATHS : PATHS + WORDS] = np.bincount([_at(f"w {w}", WORDS) for w in words], minlength=WORDS) / max(1, len(words))
        x[i, PATHS + WORDS :] = (
            np.log1p(len(b.text)) / 8, np.log1p(len(words)) / 6, b.linked / max(1, len(b.text)), before / total, len(b.text) / total, (b.path.depth if b.path else 0) / 10,
        )
        before += len(b.text)
    return x


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (page, place, feature), lengths, and for each page its places in reverse order."""
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), max(1, lengths.max()), SIZE), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
    place = np.arange(x.shape[1])[None, :]
    return x, lengths, np.where(place < lengths[:, None], lengths[:, None] - 1 - place, place)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _run(x: np.ndarray, w: dict[str, np.ndarray], d: str, keep: list | None = None, carried: list | None = None) -> np.ndarray:
    """Outputs of one direction over (page, place, feature); keep gathers what the way back needs, carried holds the state before and, at the end, after."""
    pages, places, _ = x.shape
    pre = x @ w[f"W{d}"] + w[f"b{d}"]
    h, c = carried or (np.zeros((pages, UNITS), np.float32), np.zeros((pages, UNITS), np.float32))
    out = np.zeros((pages, places, UNITS), np.float32)
    for t in range(places):
        z = pre[:, t] + h @ w[f"U{d}"]
        gates, g = _sigmoid(z[:, : 3 * UNITS]), np.tanh(z[:, 3 * UNITS :])
        i, f, o = np.split(gates, 3, axis=1)
        c2 = f * c + i * g
        tc = np.tanh(c2)
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc))
        h, c = o * tc, c2
        out[:, t] = h
    if carried is not None:
        carried[:] = h, c
    return out


def logits(x: np.ndarray, back: np.ndarray, w: dict[str, np.ndarray], keep: dict | None = None) -> np.ndarray:
    """A number for each block, above 0 for main text. Padding follows a page's blocks in either direction."""
    rows = np.arange(len(x))[:, None]
    fore = _run(x, w, "f", None if keep is None else keep.setdefault("f", []))
    rear = _run(x[rows, back], w, "r", None if keep is None else keep.setdefault("r", []))[rows, back]
    if keep is not None:
        keep |= {"hf": fore, "hr": rear}
    return fore @ w["Vf"] + rear @ w["Vr"] + x @ w["S"] + w["v"]


def _gradient(x: np.ndarray, d: str, dh_out: np.ndarray, kept: list, w: dict[str, np.ndarray], grad: dict[str, np.ndarray]) -> None:
    """Adds one direction's share, given the gradient by its outputs."""
    dz_all = np.zeros((*x.shape[:2], 4 * UNITS), np.float32)
    dh, dc = np.zeros_like(dh_out[:, 0]), np.zeros_like(dh_out[:, 0])
    for t in range(x.shape[1] - 1, -1, -1):
        h0, c0, i, f, o, g, tc = kept[t]
        dh = dh + dh_out[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_all[:, t] = dz
        grad[f"U{d}"] += h0.T @ dz
        dh, dc = dz @ w[f"U{d}"].T, dc * f
    flat = dz_all.reshape(-1, 4 * UNITS)
    grad[f"W{d}"] += x.reshape(-1, SIZE).T @ flat
    grad[f"b{d}"] += flat.sum(0)


@lru_cache(maxsize=2)
def train(pages: int = PAGES, rounds: int = ROUNDS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights of the labeller, fitted to made-up pages by Adam through time."""
    rng, made = random.Random(seed), np.random.default_rng(seed)
    w = {"Vf": np.zeros(UNITS), "Vr": np.zeros(UNITS), "S": np.zeros(SIZE), "v": np.zeros(())}
    for d in "fr":
        w |= {f"W{d}": made.normal(0, 0.1, (SIZE, 4 * UNITS)), f"U{d}": made.normal(0, 0.2, (UNITS, 4 * UNITS)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], UNITS)}
    w |= {"Vf": made.normal(0, 0.2, UNITS), "Vr": made.normal(0, 0.2, UNITS)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    rows = [sample_page(rng) for _ in range(pages)]
    rows = sorted(((features(b), np.array(y, np.float32)) for b, y in rows), key=lambda r: len(r[0]))
    groups = [rows[k : k + 28] for k in range(0, len(rows), 28)]
    step = 0
    for _ in range(rounds):
        rng.shuffle(groups)
        for group in groups:
            step += 1
            x, lengths, back = _padded([f for f, _ in group])
            x = x * (made.random(x.shape) > 0.1)
            y = np.zeros(x.shape[:2], np.float32)
            for k, (_, labels) in enumerate(group):
                y[k, : len(labels)] = labels
            real = (np.arange(x.shape[1])[None, :] < lengths[:, None]).astype(np.float32)
            keep: dict = {}
            wrong = (_sigmoid(logits(x, back, w, keep)) - y) * real / real.sum()
            at, flat = np.arange(len(x))[:, None], wrong.reshape(-1)
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["S"] = x.reshape(-1, SIZE).T @ flat
            grad["v"] = wrong.sum()
            grad["Vf"], grad["Vr"] = (keep[f"h{d}"].reshape(-1, UNITS).T @ flat for d in "fr")
            _gradient(x, "f", wrong[..., None] * w["Vf"], keep["f"], w, grad)
            _gradient(x[at, back], "r", (wrong[..., None] * w["Vr"])[at, back], keep["r"], w, grad)
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                w[k] = (w[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def long_logits(page: list[Block], w: dict[str, np.ndarray], piece: int) -> np.ndarray:
    """The numbers of one page's blocks, its features made and its states carried on piece by piece, in either direction."""
    sizes = [len(b.text) for b in page]
    before, total = np.concatenate([[0], np.cumsum(sizes)]), max(1, sum(sizes))
    z = np.zeros(len(page), np.float32)
    starts = range(0, len(page), piece)
    of = lambda a: features(page, a, a + piece, int(before[a]), total)[None]
    fore, rear = [], []
    for a in starts:
        x = of(a)
        z[a : a + piece] = (_run(x, w, "f", carried=fore) @ w["Vf"] + x @ w["S"] + w["v"])[0]
    for a in reversed(starts):
        z[a : a + piece] += (_run(of(a)[:, ::-1], w, "r", carried=rear) @ w["Vr"])[0, ::-1]
    return z


def label(pages: list[list[Block]], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page, which of its blocks are main text. Pages of more than LONG blocks go by themselves, in pieces."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    for k, page in enumerate(pages):
        if len(page) > LONG:
            out[k] = long_logits(page, w, LONG) > 0
    order = sorted((k for k in range(len(pages)) if 0 < len(pages[k]) <= LONG), key=lambda k: len(pages[k]))
    while order:
        # Pages of like lengths go together; the longest decides how many.
        group = order[-max(1, min(len(order), AT_ONCE, 20_000 // len(pages[order[-1]]))) :]
        del order[-len(group) :]
        x, _, back = _padded([features(pages[k]) for k in group])
        for k, z in zip(group, logits(x, back, w), strict=True):
            out[k] = z[: len(pages[k])] > 0
    return out


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """pages with text, the main text of the column html, and n_chars, its code points.

    Blocks labelled as main text stand in page order, joined by line feeds. A page that is null or empty or has
    no main text has an empty text. Existing columns text and n_chars are replaced.
    """
    held = pages.sparkSession.sparkContext.broadcast(weights or train())
    pages = pages.drop("text", "n_chars")
    at = pages.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for whole in batches:
            for a in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(a, AT_ONCE)
                cut = [blocks(h.as_py()) for h in batch.column(at)]
                texts = ["\n".join(b.text for b, keep in zip(page, main, strict=True) if keep) for page, main in zip(cut, label(cut, w), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, "text", "n_chars"]
                )

    return pages.mapInArrow(run, StructType([*pages.schema, StructField("text", StringType()), StructField("n_chars", LongType())]))
