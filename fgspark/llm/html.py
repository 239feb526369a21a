"""Main text of web pages: a linear-chain conditional random field labels the leaf blocks of a page, Viterbi decodes it."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page, and tags that end a block. Fixed values of HTML.
SILENT = re.compile("script|style|template|textarea|select|title", re.I)
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead tr ul label".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - set("body html iframe noscript button label caption legend td th tr tbody thead tfoot".split())
MARK = re.compile(r"<(?:(?P<long>!--|!\[CDATA\[)|(?P<short>[!?])|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+))")
#: What a tag has after its name, up to its end; nothing in it is tried a second way.
REST = re.compile(r"(?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
NAME = re.compile(r"[a-z]+")
#: Words of class names, ids and roles, and what part of a page they tell of. Fixed values.
PARTS = {
    "body": "article main content post entry story text body prose lead",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip topbar dropdown",
    "head": "header masthead banner branding logo hero contentinfo",
    "foot": "footer foot copyright colophon legal imprint credits",
    "side": "sidebar side aside complementary widget widgets related recommended more popular trending teaser rail",
    "note": "notice notices cookie cookies consent gdpr alert warning message modal popup overlay toast disclaimer",
    "sell": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner affiliate offer shop",
    "form": "form search login signin signup subscribe subscription newsletter contact register input",
    "talk": "comment comments reply replies respond discussion disqus thread reviews feedback",
    "share": "share sharing social follow facebook twitter tags tag meta byline author date",
}
PART_OF = {w: k for k, words in PARTS.items() for w in words.split()}
#: Words that such names are put together with. Fixed values.
LAYOUT = set("box wrap wrapper block container inner outer area list item link links row col column left right top bottom content section panel slot unit zone strip bar holder region space".split())


class Block:
    """A leaf block: its text, how much of it is links, and the features of its ancestors."""

    __slots__ = ("text", "linked", "above", "tag")

    def __init__(self, text: str, linked: float, above: frozenset[str], tag: str):
        self.text, self.linked, self.above, self.tag = text, linked, above, tag


def _own(tag: str, rest: str) -> frozenset[str]:
    """Features that an element gives to what is in it: its tag, what its class, id and role tell of, whether it is hidden.

    A name made of such words tells more than one that holds another word too ("cookie-notice", "popular-science").
    """
    found = {"<" + tag}
    if tag == "noscript":
        found.add("@note")
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            found.add("?hidden")
        elif name in ("class", "id", "role", "itemprop"):
            for words in map(NAME.findall, value.split()):
                sign = "@" if all(w in PART_OF or w in LAYOUT for w in words) else "~"
                found.update(sign + PART_OF[w] for w in words if w in PART_OF)
    return frozenset(found)


def marks(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, whether an end tag, rest) of all markup, in time linear in the page; tag None: no text, to be passed over.

    A quoted attribute value may hold any sign. Where quotes leave a tag open to the page's end, this tag and all later
    ones end at their first ">". A "<" that nothing closes is text; comments and silent elements that nothing closes
    reach to the end.
    """
    at, last, quotes, size = 0, page.rfind(">"), True, len(page)
    open_silent: dict[str, bool] = {}
    while (m := MARK.search(page, at)) and (m["long"] or m.end() <= last):
        if m["long"]:
            close = "-->" if m["long"] == "!--" else "]]>"
            end = page.find(close, m.end())
            at = size if end < 0 else end + 3
            yield m.start(), at, None, False, ""
            continue
        found = REST.match(page, m.end()) if quotes and not m["short"] else None
        quotes = quotes and (found is not None or bool(m["short"]))
        at = found.end() if found else page.find(">", m.end()) + 1
        if m["short"]:
            yield m.start(), at, None, False, ""
            continue
        tag, rest = m["tag"].lower(), page[m.end() : at - 1]
        if not m["end"] and SILENT.fullmatch(tag) and not rest.endswith("/"):
            end = None if open_silent.get(tag) else re.compile(rf"</{tag}(?![a-z0-9:-])[^>]*+>", re.I).search(page, at)
            open_silent[tag] = end is None
            at = size if end is None else end.end()
            yield m.start(), at, None, False, ""
            continue
        yield m.start(), at, tag, bool(m["end"]), rest


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in page order, with character references decoded and white space made single spaces.

    Any page gives blocks: unclosed elements end with their parent, stray end tags and unclosed comments are passed over.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and "<head" not in stack[-1][1]:
                anchor = len(" ".join(entities.unescape(" ".join(linked)).split()))
                out.append(Block(text, min(1.0, anchor / len(text)), stack[-1][1], stack[-1][0]))
            parts.clear()
            linked.clear()
        links = 0

    def words(text: str) -> None:
        if text:
            parts.append(text)
            if links:
                linked.append(text)

    def leave(n: int) -> None:
        for name, _ in stack[n:]:
            opened[name] -= 1
        del stack[n:]

    at = 0
    for start, end, tag, closing, rest in marks(page):
        words(page[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                flush()
                if opened[tag] > 0:
                    leave(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag == "a":
            links += 1
        elif tag == "br":
            words(" ")
        elif tag in BLOCKS:
            flush()
            if tag in CLOSES_P and stack[-1][0] == "p" or tag in ("li", "dd", "dt", "option", "tr", "td", "th") and stack[-1][0] == tag:
                leave(len(stack) - 1)
            if tag in VOID or rest.endswith("/"):
                continue
            if tag == "body":
                leave(1)
            stack.append((tag, stack[-1][1] | _own(tag, rest)))
            opened[tag] += 1
    words(page[at:])
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    rows = []
    for i, b in enumerate(found):
        n = b.text.count(" ") + 1
        size = n.bit_length()
        ends = b.text[-1] in ".!?…\"”»)"
        row = ["bias", f"n{min(size, 7)}", f"l{int(4 * b.linked)}", f"e{int(ends)}", "t" + b.tag, f"c{min(3, b.text.count(','))}", *sorted(b.above)]
        row.append(f"n{min(size, 7)}l{int(b.linked > 0.5)}e{int(ends)}")
        if "©" in b.text or "All rights" in b.text:
            row.append("copyright")
        if not b.above & ANY_PART:
            row.append("plain" + b.tag)
        row.append("first" if i == 0 else "last" if i == len(found) - 1 else "inner")
        rows.append(row)
    return rows


ANY_PART = frozenset({"<article", "<main", "<nav", "<aside", "<footer", "<header", "<form", *(sign + k for k in PARTS for sign in "@~")})

WORDS = "amber basil cedar delta ember fable grove harbor island jasper kernel lumen meadow nectar opal prairie quartz river summit tundra umber valley willow xenon yonder zephyr the of and to in is was for on with".split()


def labelled_page(rng: random.Random) -> list[tuple[Block, int]]:
    """Blocks of a made page with their labels, 1 for main text; the layout, names and texts are drawn by rng.

    The marks \\x01 and \\x02 stand around the main text, so labels hold however the page is cut into blocks.
    """

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(a, b)))

    def prose(a: int, b: int) -> str:
        text = words(a, b).capitalize()
        for _ in range(len(text) // 60):
            text = text.replace(" the ", rng.choice([", the ", ". The ", " the "]), 1)
        return text + rng.choice([".", ".", ".", "!", "?", ""])

    def name(*kinds: str) -> str:
        if rng.random() < 0.25:
            return ""
        roll = rng.random()
        if roll < 0.25:  # names hold other words too, and now and then any word
            kinds = tuple(PARTS) if roll < 0.04 else kinds
            value = rng.choice([f"{rng.choice(PARTS[rng.choice(kinds)].split())}-{rng.choice(WORDS)}", f"{rng.choice(WORDS)}-{rng.choice(PARTS[rng.choice(kinds)].split())}"])
        else:
            value = rng.choice(PARTS[rng.choice(kinds)].split()) + rng.choice(["", "", "-box", "-wrap", " block", "_1"])
        return f' {rng.choice(["class", "class", "id"])}="{value}"'

    def links(n: int) -> str:
        return "".join(f"<li><a href=/{i}>{words(1, 4)}</a></li>" for i in range(n))

    def wrap(tags: str, kinds: tuple[str, ...], inside: str) -> str:
        tag = rng.choice(tags.split())
        attribute = rng.choice([" hidden", ' aria-hidden="true"', ' style="display:none"']) if rng.random() < 0.04 else name(*kinds) if tag != "div" or rng.random() < 0.1 else f' class="{rng.choice(PARTS[rng.choice(kinds)].split())}"'
        return f"<{tag}{attribute}>{inside}</{tag}>"

    def para(label: bool, a: int = 5, b: int = 80) -> str:
        text = prose(a, b)
        if rng.random() < 0.25:
            text = text.replace(" ", f" <a href=/x>{words(1, 3)}</a> ", 1)
        if rng.random() < 0.2:
            text = f"<b>{text}</b>"
        return f"<p>\x01{text}\x02</p>" if label else f"<p>{text}</p>"

    def menu() -> str:
        return wrap("nav nav div ul", ("menu",), f"<ul>{links(rng.randint(2, 8))}</ul>")

    def head() -> str:
        return wrap("header header div", ("head",), f"<{(t := rng.choice(['div', 'p', 'h1', 'h2']))}>{words(1, 5)}</{t}>" + (f"<p>{prose(3, 12)}</p>" if rng.random() < 0.4 else "") + (menu() if rng.random() < 0.4 else ""))

    def ad() -> str:
        return wrap("div div aside section", ("sell",), rng.choice([prose(3, 30), para(False, 4, 30), f"<a href=/b>{words(2, 6)}</a>"]))

    def note() -> str:
        return wrap("div div section aside", ("note",), para(False, 4, 30) + rng.choice(["", "<button>OK</button>", f"<a href=/c>{words(1, 3)}</a>"]))

    def side() -> str:
        return wrap("aside aside div", ("side",), f"<h3>{words(1, 4)}</h3>" + rng.choice([f"<ul>{links(rng.randint(2, 7))}</ul>", para(False, 4, 40)]))

    def form() -> str:
        return wrap("form form", ("form",), f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>" + (f"<p>{prose(3, 15)}</p>" if rng.random() < 0.5 else ""))

    def talk() -> str:
        one = lambda: wrap("div article li section", ("talk",), f"<p>{words(1, 2)}</p>" + para(False, 3, 50))
        return wrap("section div", ("talk",), f"<h3>{words(1, 2)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))) + (form() if rng.random() < 0.4 else ""))

    def foot() -> str:
        return wrap("footer footer div", ("foot",), f"<p>&copy; {words(1, 4)}</p>" + rng.choice(["", prose(4, 20), f"<ul>{links(3)}</ul>"]))

    inside = [f"<{(t := rng.choice(['h1', 'h1', 'h2']))}>\x01{words(2, 10).capitalize()}\x02</{t}>"] if rng.random() < 0.85 else []
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
        kind = rng.random()
        if kind < 0.72:
            inside.append(para(True, 1 if rng.random() < 0.1 else 5, rng.choice([15, 60, 150])))
        elif kind < 0.8:
            inside.append(f"<{(t := rng.choice(['h2', 'h3']))}>\x01{words(1, 6).capitalize()}\x02</{t}>")
        elif kind < 0.86:
            inside.append("<ul>" + "".join(f"<li>\x01{prose(2, 15)}\x02</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.9:
            inside.append(f"<blockquote>\x01{prose(5, 30)}\x02</blockquote>")
        elif kind < 0.93:
            inside.append(f"<table><tr><td>\x01{words(1, 4)}\x02</td><td>\x01{words(1, 4)}\x02</td></tr></table>")
        else:
            inside.append(rng.choice([ad, note, form, side])())
    shape = rng.random()
    body = "".join(inside)
    body = f"<article{name('body')}>{body}</article>" if shape < 0.5 else f"<main{name('body')}>{body}</main>" if shape < 0.65 else f'<div class="{rng.choice(PARTS["body"].split())}">{body}</div>' if shape < 0.78 else f'<div class="{rng.choice(PARTS[rng.choice(list(PARTS))].split())}-{rng.choice(WORDS)}">{body}</div>' if shape < 0.85 else f"<div>{body}</div>" if shape < 0.93 else body
    if rng.random() < 0.3:
        body = f"<main>{body}{talk() if rng.random() < 0.3 else ''}</main>"
    before = [f() for f in (head, menu, note, ad, form, side) if rng.random() < 0.4]
    after = [f() for f in (talk, side, ad, note, form, menu, foot) if rng.random() < 0.4]
    rng.shuffle(before)
    found, inside_main, rows = blocks("<html><head><title>x</title></head><body>" + "".join(before) + body + "".join(after)), False, []
    for b in found:
        inside_main = inside_main or "\x01" in b.text
        rows.append((b, int(inside_main)))
        inside_main = inside_main and "\x02" not in b.text
        b.text = b.text.replace("\x01", "").replace("\x02", "").strip() or "."
    return rows


def alike(found: list[Block]) -> list[int]:
    """For each block after the first, whether it has the same ancestors' features as the one before."""
    return [int(b.above == a.above) for a, b in zip(found, found[1:])]


@cache
def train(pages: int = 1500, rounds: int = 120, seed: int = 11, rate: float = 0.15, decay: float = 0.02) -> tuple[dict[str, float], np.ndarray]:
    """(weight of label 1 by feature, step weights by alike(), label and next label), fitted by maximum likelihood on made
    pages with known labels."""
    rng = random.Random(seed)
    made = [rows for _ in range(pages) if (rows := labelled_page(rng))]
    index: dict[str, int] = {}
    feats = [[index.setdefault(f, len(index)) for f in row] for rows in made for row in features([b for b, _ in rows])]
    owner, feature = np.repeat(np.arange(len(feats)), [len(f) for f in feats]), np.array([i for f in feats for i in f])
    y = np.array([v for rows in made for _, v in rows])
    sizes = np.array([len(rows) for rows in made])
    most, ends = sizes.max(), np.cumsum(sizes)
    place, same = np.full((len(made), most), -1), np.zeros((len(made), most - 1), dtype=int)
    for k, (e, n) in enumerate(zip(ends, sizes)):
        place[k, :n] = np.arange(e - n, e)
        same[k, : n - 1] = alike([b for b, _ in made[k]])
    real = place >= 0
    both = real[:, 1:]
    kind = [both & (same == s) for s in (0, 1)]
    w, steps = np.zeros(len(index)), np.zeros((2, 2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(steps), np.zeros_like(steps)]
    label, after = y[place[:, :-1]], y[place[:, 1:]]
    seen = np.array([[[((label == a) & (after == b) & k).sum() for b in (0, 1)] for a in (0, 1)] for k in kind], dtype=float)
    for k in range(1, rounds + 1):
        e = np.bincount(owner, weights=w[feature], minlength=len(feats))
        grid, move = np.zeros((len(made), most, 2)), steps[same]
        grid[..., 1] = np.where(real, e[place], 0)
        forward, backward = np.zeros_like(grid), np.zeros_like(grid)
        forward[:, 0] = grid[:, 0]
        for t in range(1, most):
            forward[:, t] = grid[:, t] + np.logaddexp(forward[:, t - 1, 0, None] + move[:, t - 1, 0], forward[:, t - 1, 1, None] + move[:, t - 1, 1])
        for t in range(most - 2, -1, -1):
            ahead = grid[:, t + 1] + backward[:, t + 1]
            there = np.logaddexp(move[:, t, :, 0] + ahead[:, 0, None], move[:, t, :, 1] + ahead[:, 1, None])
            backward[:, t] = np.where(real[:, t + 1, None], there, 0)
        total = forward + backward
        p = 1 / (1 + np.exp(np.clip(total[..., 0] - total[..., 1], -50, 50)))
        pair = forward[:, :-1, :, None] + move + (grid + backward)[:, 1:, None, :]
        pair = np.exp(pair - pair.max(axis=(2, 3), keepdims=True))
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        gw = np.bincount(feature, weights=(p[real] - y[place[real]])[owner], minlength=len(index)) + decay * w
        gs = np.array([(pair * x[..., None, None]).sum(axis=(0, 1)) for x in kind]) - seen + decay * steps
        for target, g, j in ((w, gw, 0), (steps, gs, 2)):
            state[j] = 0.9 * state[j] + 0.1 * g
            state[j + 1] = 0.99 * state[j + 1] + 0.01 * g * g
            target -= rate * (state[j] / (1 - 0.9**k)) / (np.sqrt(state[j + 1] / (1 - 0.99**k)) + 1e-8)
    return {f: float(w[i]) for f, i in index.items()}, steps


def viterbi(emission: list[float], steps: np.ndarray, same: list[int]) -> list[int]:
    """The likeliest labels; label 0 weighs nothing at a block, label 1 its emission. Of equals, 0."""
    moves, a, b, back = steps.tolist(), 0.0, 0.0, []
    for i, e in enumerate(emission):
        if not i:
            a, b = 0.0, e
            continue
        (s00, s01), (s10, s11) = moves[same[i - 1]]
        to0, to1 = b + s10 > a + s00, b + s11 > a + s01
        back.append((to0, to1))
        a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01) + e
    if not emission:
        return []
    out = [int(b > a)]
    for to0, to1 in reversed(back):
        out.append(int(to1 if out[-1] else to0))
    return out[::-1]


def labels(found: list[Block], weights: dict[str, float], steps: np.ndarray) -> list[int]:
    return viterbi([sum(weights.get(f, 0.0) for f in row) for row in features(found)], steps, alike(found))


def main_text(page: str, weights: dict[str, float], steps: np.ndarray) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, labels(found, weights, steps)) if y)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: a row per row of pages.

    A null html is empty; a page without main text has an empty text. Null ids and urls stay. Repeated rows stay. An
    empty table gives no rows. Other columns are not read. A page is taken whole; the model is the same for all pages.
    """
    model = pages.sparkSession.sparkContext.broadcast(train())

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, steps = model.value
        for batch in batches:
            yield pa.array([main_text(page.as_py() or "", weights, steps) for page in batch], pa.string())

    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), run(F.col(html_col).cast("string")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
