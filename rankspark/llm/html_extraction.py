"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is a vector: hashed
elements of its tag path (tags, classes, ids), hashed words and a few lengths. A
bidirectional LSTM in numpy reads the whole sequence, so every block is judged
with the page before and after it, and labels it as main text or not.

No page comes with labels. The labeller is fitted on a bounded sample of the
given pages of any length, labelled by their own containers (article, nav,
footer, …), and on re-laid pages: the sample's texts set anew into other common
layouts, with the containers that menus, notices, adverts, forms and comments
use elsewhere. Tasks turn sampled pages into ranges of blocks, so that what the
driver holds does not grow with the pages.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_batches

# ---- parameters --------------------------------------------------------------
#: The labeller is fitted on at most so many pages, and in all on about as many ranges of neighbouring blocks; every page is labelled whole.
MAX_PAGES = 240
LAYOUTS_PER_PAGE = 5
RANGE_BLOCKS = 120
#: A longer text is set into re-laid pages by its first characters; where it stands itself it counts whole.
EXCERPT_CHARS = 2_000
HIDDEN = 20
EPOCHS = 5
BATCH = 24
RATE = 0.01
SEED = 7
PATH_SLOTS, WORD_SLOTS, LENGTHS = 512, 64, 6
INNER_NAMES = 8
CELLS = 20_000
# ---- fixed values: element kinds and the names that layouts use ---------------
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option optgroup p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg title iframe object canvas math".split())
SPACED = frozenset("br wbr img td th".split()) - {"wbr"}
MAIN = frozenset("article main".split())
OTHER = frozenset("nav aside footer form menu dialog button select textarea fieldset".split())
MAIN_NAMES = (
    "content main-content post post-content post-body entry entry-content article article-body article-content story story-body text body-text "
    "page-content main-text blog-post news-article document"
).split()
OTHER_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar site-nav main-menu tabs pagination pager links".split(),
    "header": "header site-header masthead banner page-header logo top brand".split(),
    "footer": "footer site-footer copyright page-footer bottom legal colophon".split(),
    "sidebar": "sidebar side aside widget widgets rail right-rail related recommended popular trending archive tags categories".split(),
    "notice": "notice cookie cookie-notice cookies consent gdpr alert message popup modal overlay announcement disclaimer privacy".split(),
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner-ad commercial partner".split(),
    "form": "form login signup subscribe newsletter search search-form contact register share social".split(),
    "comments": "comments comment comment-list comment-body reply replies responses discussion disqus reader-comments user-comments".split(),
}
TAGS_OF = {
    "menu": ("nav", "div", "ul", "menu"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"),
    "notice": ("div", "section", "dialog", "aside"), "advert": ("div", "aside", "section", "ins"), "form": ("form", "div"),
    "comments": ("section", "div", "ol", "ul"),
}
#: Set into layouts where no sampled page has text of its own.
SPARE_FILLERS = ["Home", "About us"]
SPARE_TEXTS = (
    "A new bridge across the river was opened on Monday.",
    "The council had argued over its cost for nearly ten years, and many had given up hope.",
    "Most of the work was done by night so that trains could run during the day.",
    "What comes next?",
    "People who live nearby say that the noise was hard to bear, but that they are glad of the shorter way to town.",
    "The first walkers crossed it in light rain.",
    "Engineers will measure how the wind moves it until the end of the winter.",
    "It carries two lanes, a path for bicycles and a wide footway on the southern side.",
    "An earlier crossing stood at the same place until a flood took it away.",
    "A short history of the crossing",
    "Those who wish to see the plans can do so at the library, where they are shown for the rest of the month.",
    "Repairs to the road on the other bank are to follow in spring.",
)
# ------------------------------------------------------------------------------

MARK = "\ue000"  # a private character in front of main blocks of re-laid pages
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """``(path, text, characters inside links)`` of every block with text, in page order.

    Comments, scripts and the like are skipped. Text that only inline tags
    interrupt is one block; references are decoded, white space is one space.
    """
    found, stack, parts = [], [], []
    path: tuple[str, ...] = ()
    linked = at = 0

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            found.append((path, text, linked))
        parts, linked = [], 0

    def add(raw):
        nonlocal path, linked
        if raw:
            text = html.unescape(raw)
            if not parts or not "".join(parts).strip():
                path = tuple(name for _, names in stack for name in names)
            parts.append(text)
            if any(tag == "a" for tag, _ in stack[-6:]):
                linked += len(text)

    while at < len(page):
        mark = page.find("<", at)
        if mark < 0:
            add(page[at:])
            break
        add(page[at:mark])
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = len(page) if end < 0 else end + 1
            continue
        tag = TAG.match(page, mark)
        if not tag:
            end = page.find(">", mark) if page[mark + 1 : mark + 2].isalpha() or page[mark + 1 : mark + 2] == "/" else -1
            if end < 0:  # a lone sign
                add("<")
                at = mark + 1
            else:
                at = end + 1
            continue
        at = tag.end()
        closing, name = tag[1], tag[2].lower()
        if name in BLOCKS:
            flush()
        elif name in SPACED:
            parts.append(" ")
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            continue
        if name in SKIPPED:
            if not tag[3].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = len(page) if not end and name in ("script", "style", "title") else end.end() if end else at
            continue
        if name in VOID:
            continue
        if name in BLOCKS:  # such an element ends an open paragraph, a list item the one before
            ends = {"li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "option": ("option",)}
            stops = {"li": ("ul", "ol", "menu"), "td": ("table",), "th": ("table",), "tr": ("table",), "dd": ("dl",), "dt": ("dl",)}.get(name, ("td", "th", "li", "div", "article", "section"))
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends.get(name, ("p",)):
                    del stack[depth:]
                    break
                if stack[depth][0] in stops:
                    break
        names = [name]
        for kind, *values in NAMES.findall(tag[3]) if tag[3] else ():
            names += [f"{'#' if kind.lower() == 'id' else '.'}{v}" for v in "".join(values).lower().split()]
        stack.append((name, tuple(names)))
    flush()
    return found


def _path_names(path: tuple[str, ...]) -> list[str]:
    """What the path says: all its elements, names also by their parts, and the inner ones once more as such."""
    out = []
    for x in path:
        if x[0] in "#.":
            out += [f"n={x[1:]}", *(f"n={part}" for part in re.split(r"[-_\d]+", x[1:]) if part and part != x[1:])]
        else:
            out.append(f"t={x}")
    inner = [f"in={x}" for x in path[-INNER_NAMES:]]
    return [*dict.fromkeys(out + inner), f"last={path[-1] if path else ''}", f"tags={'/'.join(x for x in path[-6:] if x[0] not in '#.')}"]


def _slot(text: str, slots: int) -> int:
    return xxhash.xxh64_intdigest(text) % slots


def vectors(page: list[tuple[tuple[str, ...], str, int]], cache: dict) -> np.ndarray:
    """One row per block."""
    out = np.zeros((len(page), PATH_SLOTS + WORD_SLOTS + LENGTHS), np.float32)
    for row, (path, text, linked) in zip(out, page):
        slots = cache.get(path)
        if slots is None:
            if len(cache) > 50_000:
                cache.clear()
            slots = cache[path] = np.array(sorted({_slot(n, PATH_SLOTS) for n in _path_names(path)}))
        row[slots] = 1.0
        words = text.lower().split()
        counts = np.bincount([_slot(w, WORD_SLOTS) for w in words], minlength=WORD_SLOTS)
        row[PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = 0.3 * counts / len(words) ** 0.5
        share = min(1.0, linked / max(1, len(text)))
        row[PATH_SLOTS + WORD_SLOTS :] = (np.log1p(len(words)) / 4, share, text[-1] in ".!?", len(words) < 4, "©" in text, 1.0)
    return out


# ---- the network ---------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_network() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    inputs, h = PATH_SLOTS + WORD_SLOTS + LENGTHS, HIDDEN
    net = {}
    for way in "fb":
        net[f"W{way}"] = rng.normal(0, 0.1, (inputs, 4 * h))
        net[f"U{way}"] = rng.normal(0, 1 / h**0.5, (h, 4 * h))
        net[f"b{way}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
    return {k: v.astype(np.float32) for k, v in (net | {"V": rng.normal(0, 0.1, 2 * h), "v": np.zeros(1)}).items()}


def _run(net, x, mask, way):
    """States of one direction; ``x`` is (steps, pages, inputs), ``mask`` (steps, pages)."""
    steps, pages, _ = x.shape
    h, c = (np.zeros((pages, HIDDEN), np.float32) for _ in range(2))
    into = x @ net[f"W{way}"] + net[f"b{way}"]
    out, memory = np.zeros((steps, pages, HIDDEN), np.float32), []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = into[t] + h @ net[f"U{way}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[t][:, None]
        new = f * c + i * g
        squashed = np.tanh(new)
        memory.append((t, h, c, i, f, o, g, squashed, m))
        c, h = m * new + (1 - m) * c, m * (o * squashed) + (1 - m) * h
        out[t] = h
    return out, memory


def _run_back(net, x, memory, way, d_out, grads):
    d_h, d_c = (np.zeros_like(memory[0][1]) for _ in range(2))
    d_into = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
    for t, h, c, i, f, o, g, squashed, m in reversed(memory):
        d_h = d_h + d_out[t]
        own_h, own_c = d_h * m, d_c * m
        d_new = own_c + own_h * o * (1 - squashed**2)
        d_z = np.hstack([d_new * g * i * (1 - i), d_new * c * f * (1 - f), own_h * squashed * o * (1 - o), d_new * i * (1 - g**2)])
        grads[f"U{way}"] += h.T @ d_z
        d_into[t] = d_z
        d_h = d_z @ net[f"U{way}"].T + d_h * (1 - m)
        d_c = d_new * f + d_c * (1 - m)
    flat = d_into.reshape(-1, 4 * HIDDEN)
    grads[f"W{way}"] += x.reshape(-1, x.shape[2]).T @ flat
    grads[f"b{way}"] += flat.sum(axis=0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), PATH_SLOTS + WORD_SLOTS + LENGTHS), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1.0
    return x, mask


def probabilities(net: dict, pages: list[np.ndarray]) -> list[np.ndarray]:
    """P(main) of every block of every page; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        longest = len(pages[order[-1]])
        group = [order.pop() for _ in range(min(len(order), max(1, CELLS // longest)))]
        x, mask = _padded([pages[k] for k in group])
        states = np.concatenate([_run(net, x, mask, way)[0] for way in "fb"], axis=2)
        p = _sigmoid(states @ net["V"] + net["v"][0])
        for column, k in enumerate(group):
            out[k] = p[: len(pages[k]), column]
    return out


def fit_network(pages: list[np.ndarray], labels: list[np.ndarray]) -> dict:
    """Adam on the cross-entropy of all blocks, by backpropagation through the sequences."""
    net, rng = new_network(), np.random.default_rng(SEED)
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    by_length = sorted(range(len(pages)), key=lambda k: len(pages[k]))
    batches = [by_length[at : at + BATCH] for at in range(0, len(by_length), BATCH)]
    step = 0
    for epoch in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            x, mask = _padded([pages[k] for k in batches[b]])
            y = np.zeros_like(mask)
            for column, k in enumerate(batches[b]):
                y[: len(labels[k]), column] = labels[k]
            runs = {way: _run(net, x, mask, way) for way in "fb"}
            states = np.concatenate([runs[way][0] for way in "fb"], axis=2)
            error = (_sigmoid(states @ net["V"] + net["v"][0]) - y) * mask / mask.sum()
            grads = {k: np.zeros_like(v) for k, v in net.items()}
            grads["V"] += (states * error[:, :, None]).sum(axis=(0, 1))
            grads["v"] += error.sum()
            d_states = error[:, :, None] * net["V"]
            for k, way in enumerate("fb"):
                _run_back(net, x, runs[way][1], way, d_states[:, :, k * HIDDEN : (k + 1) * HIDDEN], grads)
            step += 1
            for k in net:
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.001 * (grads[k] ** 2 - second[k])
                rate = RATE * (1 - epoch / (EPOCHS + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                net[k] -= (rate * first[k] / (second[k] ** 0.5 + 1e-8)).astype(np.float32)
    return net


# ---- labels --------------------------------------------------------------------


def own_label(path: tuple[str, ...]) -> int | None:
    """1 or 0 where a page's containers say what a block is, else None."""
    names = {part for x in path if x[0] in "#." for part in (x[1:], *re.split(r"[-_]+", x[1:]))}
    if OTHER.intersection(path) or any(names.intersection(v) for v in OTHER_NAMES.values()):
        return 0
    if MAIN.intersection(path):
        return 1
    return 0 if "header" in path else 1 if names.intersection(MAIN_NAMES) else None


def relaid(rng: random.Random, main: list[str], rest: list[str]) -> str:
    """A page of the given texts in some common layout; main blocks carry ``MARK``."""
    text = lambda s: html.escape(s, quote=False)
    some = lambda: " ".join(rng.choice(rest or ["Home"]).split()[: rng.randint(1, 14)])

    def named(name, kind=None):
        if kind and rng.random() < 0.15 and name in OTHER:
            return ""
        value = rng.choice(OTHER_NAMES[kind] if kind else MAIN_NAMES)
        if rng.random() < 0.3:
            value += rng.choice(["-1", "-box", "-wrap", "-inner", "_container", "-area"])
        return f' {rng.choice(["class", "class", "id"])}="{value}"'

    def boiler(kind):
        tag = rng.choice(TAGS_OF[kind])
        items = [text(some()) for _ in range(rng.randint(1, 7 if kind in ("menu", "comments", "sidebar") else 3))]
        if kind == "comments":
            items = [text(rng.choice(main + rest)) for _ in items]  # readers write prose as well
        if tag in ("ul", "ol", "menu"):
            inner = "".join(f"<li>{x}</li>" if kind != "menu" else f'<li><a href="#">{x}</a></li>' for x in items)
        elif kind in ("menu", "sidebar") and rng.random() < 0.7:
            inner = "<ul>" + "".join(f'<li><a href="/x">{x}</a></li>' for x in items) + "</ul>"
        elif kind == "form":
            inner = "".join(f"<label>{x}</label><input>" for x in items[:3]) + f"<button>{text(some())}</button>"
        elif kind == "comments":
            inner = "".join(f'<div class="{rng.choice(("comment", "reply", "entry"))}"><p>{x}</p></div>' for x in items)
        else:
            inner = "".join(rng.choice((f"<p>{x}</p>", f"<div>{x}</div>", x + "<br>", f"<span>{x}</span>")) for x in items)
        if kind == "header" and rng.random() < 0.5:
            inner = f"<h1>{inner}</h1>" if rng.random() < 0.3 else f"<div>{inner}</div>"
        if kind == "footer" and rng.random() < 0.6:
            inner = "&copy; " + inner
        return f"<{tag}{named(tag, kind)}>{inner}</{tag}>"

    body = []
    for k, m in enumerate(main):
        tag = rng.choice(("h1", "h2")) if k == 0 and rng.random() < 0.8 else rng.choice(("p", "p", "p", "p", "p", "li", "blockquote", "div", "h2"))
        body.append(f"<{tag}>{MARK}{text(m)}</{tag}>" if tag != "li" else f"<ul><li>{MARK}{text(m)}</li></ul>")
        if rng.random() < 0.06:
            body.append(boiler(rng.choice(("advert", "notice", "form", "sidebar"))))
    kinds = ("comments", "comments", "sidebar", "advert", "menu", "form", "notice", "header", "footer")
    around = lambda chance: boiler(rng.choice(kinds)) if rng.random() < chance else ""
    body.append(around(0.25))
    holder = rng.choice(("article", "article", "main", "div", "section"))
    name = named(holder) if holder in ("div", "section") and rng.random() < 0.9 or rng.random() < 0.4 else ""
    inside = f"<{holder}{name}>{''.join(body)}</{holder}>"
    for _ in range(rng.randint(0, 2)):
        wrap = rng.choice(("div", "main", "section"))
        inside = f"{around(0.25)}{inside}{around(0.4)}"
        inside = f'<{wrap} {rng.choice(("class", "id"))}="{rng.choice(("wrapper", "container", "page", "row", "layout", "site", "col"))}">{inside}</{wrap}>'
    before = "".join(boiler(k) for k in rng.sample(("menu", "header", "notice", "advert", "form", "sidebar"), rng.randint(0, 4)))
    after = "".join(boiler(k) for k in rng.sample(("comments", "footer", "sidebar", "advert", "form", "notice", "menu", "comments"), rng.randint(0, 5)))
    return f"<html><head><title>{text(main[0] if main else '')}</title></head><body>{before}{inside}{after}</body></html>"


def ranges(found: list, most: int, seed: int) -> list[list]:
    """At most ``most`` equal ranges of a page's blocks; its begin, its end and one between come first, in any order."""
    n = -(-len(found) // RANGE_BLOCKS)
    cuts = [len(found) * k // n for k in range(n + 1)] if n else [0]
    rng = random.Random(seed)
    inner = rng.sample(range(1, n - 1), min(most, n - 2)) if n > 2 else []
    ends = [*range(n)][:1] + [*range(n)][1:][-1:] + inner[:1]
    rng.shuffle(ends)
    return [found[cuts[k] : cuts[k + 1]] for k in (ends + inner[1:])[:most]]


def _excerpt(text: str) -> str:
    return text if len(text) <= EXCERPT_CHARS else text[:EXCERPT_CHARS].rsplit(" ", 1)[0]


def examples(page: str, most: int, cache: dict) -> list[tuple]:
    """``(seed, range, vectors, labels, main texts, other texts)`` of a page's ranges, small enough for the driver.

    Vectors and labels are None where the page's containers leave a block of the range open.
    """
    found, seed = blocks(page), xxhash.xxh64_intdigest(page.encode("utf-8", "replace")) >> 1
    out = []
    for k, part in enumerate(ranges(found, most, seed)):
        known = [own_label(path) for path, _, _ in part]
        own = labels = None
        if None not in known:
            own, labels = zlib.compress(vectors(part, cache).tobytes(), 1), np.array(known, np.float32).tobytes()
        main = [_excerpt(text) for (_, text, _), y in zip(part, known) if y != 0] or [_excerpt(part[0][1])]
        rest = [_excerpt(text) for (_, text, _), y in zip(part, known) if y == 0]
        out.append((seed, k, own, labels, main, rest))
    return out


def fit(sample: list[tuple]) -> dict:
    """The labeller from ``examples``; without any, from re-laid pages of fixed texts."""
    rng, cache = random.Random(SEED), {}
    rows, labels = [], []
    sample = sample or [(0, 0, None, None, rng.choices(SPARE_TEXTS, k=12), []) for _ in range(MAX_PAGES // LAYOUTS_PER_PAGE)]
    fillers = [text for *_, rest in sample for text in rest] or SPARE_FILLERS
    for _, _, own, known, main, _ in sample:
        if own is not None:
            rows.append(np.frombuffer(zlib.decompress(own), np.float32).reshape(-1, PATH_SLOTS + WORD_SLOTS + LENGTHS))
            labels.append(np.frombuffer(known, np.float32))
        for _ in range(LAYOUTS_PER_PAGE):
            start = rng.randrange(len(main)) if len(main) > 40 else 0
            part = main[start : start + rng.randint(1, 40)]
            again = blocks(relaid(rng, part, rng.sample(fillers, min(len(fillers), 12))))
            labels.append(np.array([t.startswith(MARK) for _, t, _ in again], np.float32))
            rows.append(vectors([(p, t.replace(MARK, "") or " ", n) for p, t, n in again], cache))
    return fit_network(rows, labels)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict | None:
    """Fits on a bounded sample drawn by a hash of the id from all pages that are not empty; None if all are."""
    rows = pages.select(pages[id_col].alias("of"), pages[html_col].cast("string").alias("html")).where("length(html) > 0")
    drawn = rows.select("of").distinct().orderBy(F.xxhash64(F.lit("sample"), "of"), "of").limit(MAX_PAGES)
    chosen = drawn.collect()  # at most MAX_PAGES ids
    if not chosen:
        return None
    most = MAX_PAGES // len(chosen)
    own = pages.sparkSession.createDataFrame(chosen, drawn.schema).withColumnRenamed("of", "drawn")
    texts = rows.join(F.broadcast(own), rows["of"].eqNullSafe(own["drawn"])).groupBy("of").agg(F.min("html").alias("html")).select("html")

    def run(batches):
        cache: dict = {}
        for _, raw in chunks(batches, "html"):
            found = [x for b in raw for x in examples(b.decode("utf-8", "replace"), most, cache)]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()))
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["seed", "part", "own", "labels", "main", "rest"])

    made = map_batches(texts, "seed long, part int, own binary, labels binary, main array<string>, rest array<string>", run)
    return fit(sorted((tuple(r) for r in made.collect()), key=lambda r: r[:2]))


def main_text(net: dict, pages: list[str], cache: dict) -> list[str]:
    parsed = [blocks(p) for p in pages]
    labelled = probabilities(net, [vectors(found, cache) for found in parsed])
    return [" ".join(text for (_, text, _), p in zip(found, own) if p > 0.5) for found, own in zip(parsed, labelled)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    Null and empty pages, and pages without main text, give an empty text.
    Repeated rows stay; an empty table gives an empty one.
    """
    net = train(pages, id_col, html_col)
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        cache: dict = {}
        for batch, raw in chunks(batches, "html"):
            texts = [""] * len(raw) if shared.value is None else main_text(shared.value, [b.decode("utf-8", "replace") for b in raw], cache)
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")
    )
    return map_batches(rows, "page_id long, url string, text string, n_chars long", run)
