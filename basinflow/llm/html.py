"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. A block has its word count and link
density, those of its neighbours, and what the markup says about its place. A Spark ML decision
tree is trained on the small labelled table below and its rules run over every block; blocks that
it takes for content are joined in page order.

null or empty html, or a page without content: the empty string. Character references are decoded
(unknown or broken ones stay as they are), white space inside a block becomes one space. Repeated
pages keep their rows, null ids and urls stay null, other columns are not read. Pages are handled
whole, one row at a time, without a shuffle, in time that grows with their length: a tag that is never
closed takes the rest of the page, and open elements are found without a search.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.llm.bpe import text_slices
from basinflow.llm.common import small_batches

# Names of HTML elements and words that sites use in class, id and role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas noembed noframes xmp head".split())
ASIDE = frozenset("nav footer aside form menu dialog button select option fieldset".split())
MAIN = frozenset("article main".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|topbar|toolbar"
    r"|comments?|disqus|replies|respond|discussion|notice|notices|cookies?|consent|gdpr|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|form|share|sharing|social|related|recommended|widget|pagination|pager|copyright|legal|disclaimer|skip)(?:$|[\s_-])",
    re.I,
)
#: These words mark what is not content only outside the article: within it, they mark its title.
TITLE_HINT = re.compile(r"(?:^|[\s_-])(?:header|head|masthead)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: A comment or tag that is not closed goes on to the end of the page, so that every match succeeds where
#: it begins and pages are read in one pass. A quote that is not closed is no quote (see PLAIN_TAG); as
#: there is none of its kind behind it, that is tried twice a page at most.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^>\"'])*+)(?:>|\Z)", re.S)
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Name and value of an attribute; values are consumed whole, so that nothing in them is taken for a name.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Ends of the elements that close when a new one of their kind begins.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = ("ul", "ol", "dl", "table", "div", "article", "section", "select")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "aside", "main", "heading")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    aside: int
    main: int
    heading: int


@dataclass
class Open:
    name: str
    aside: bool = False
    main: bool = False
    hidden: bool = False
    link: bool = False


class Stack:
    """The open elements. Where each name, and the last block, is open is kept, so that an end tag costs
    the elements that it closes, however deep they stand."""

    def __init__(self):
        self.items: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.state = {"aside": 0, "main": 0, "hidden": 0, "link": 0, "head": 0}

    def count(self, x: Open, by: int) -> None:
        for flag in ("aside", "main", "hidden", "link"):
            self.state[flag] += by * getattr(x, flag)
        self.state["head"] += by * (x.name in HEADINGS)

    def push(self, x: Open) -> None:
        self.places.setdefault(x.name, []).append(len(self.items))
        if x.name not in INLINE:
            self.blocks.append(len(self.items))
        self.items.append(x)
        self.count(x, 1)

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names, -1 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, k: int) -> None:
        while len(self.items) > k:
            x = self.items.pop()
            self.places[x.name].pop()
            if x.name not in INLINE:
                self.blocks.pop()
            self.count(x, -1)

    def end(self, name: str) -> None:
        """An end tag: an inline one does not reach out of its block."""
        k = self.last(name)
        if k >= 0 and not (name in INLINE and self.blocks and self.blocks[-1] > k):
            self.close(k)

    def begin(self, name: str) -> None:
        """What ends because an element of this name begins, within the list, table or section at hand."""
        if name in CLOSES:
            k = self.last(*CLOSES[name])
            if k > self.last(*SCOPES):
                self.close(k)


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag; the first one of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text or ""):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    stack, parts = Stack(), []
    state = stack.state
    ends: dict[str, bool] = {}  # names of raw elements whose end tag does not come again
    if not page:
        return out

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(entities.unescape(p).split()) for p, a in parts if a)
                words = len(text.split())
                out.append(Block(text, words, min(linked, words), int(state["aside"] > 0), int(state["main"] > 0), int(state["head"] > 0)))
            parts.clear()

    def after(name: str, at: int) -> int:
        """Where a raw element ends. Without an end tag it takes the rest of the page; a head ends at
        the body, or is empty."""
        for pattern in (rf"</{re.escape(name)}\s*>", *(["(?=<body)"] if name == "head" else [])):
            if pattern not in ends:
                m = re.compile(pattern, re.I).search(page, at)
                if m:
                    return m.end()
                ends[pattern] = True
        return at if name == "head" else len(page)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not state["hidden"]:
            parts.append((text, state["link"] > 0))
        if not m:
            break
        if m[2] and m.end(3) == n:
            m = PLAIN_TAG.match(page, m.start()) or m
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not state["hidden"]:
                parts.append((m[0][9:].removesuffix("]]>").replace("&", "&amp;"), state["link"] > 0))
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            stack.end(name)
            continue
        stack.begin(name)
        if name in VOID or (m[3] or "").endswith("/") and name not in RAW:
            continue
        if name in RAW:
            flush()
            at = after(name, at)
            continue
        given = attributes(m[3])
        main = name in MAIN or given.get("role") in ("main", "article")
        hint = f"{given.get('class', '')} {given.get('id', '')}"
        inside = state["main"] > 0
        hinted = name not in ("body", "html") and bool(HINT.search(hint) or not inside and TITLE_HINT.search(hint))
        aside = name in ASIDE or name == "header" and not inside or given.get("role", "").lower() in ROLES or hinted and not main
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I))
        if (aside or hidden) and name in INLINE:
            flush()
        stack.push(Open(name, aside, main, hidden, name == "a"))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; a missing neighbour counts as an empty block."""
    own = np.array([(b.words, b.linked / b.words) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    place = np.array([(b.aside, b.main, b.heading) for b in found], float).reshape(-1, 3)
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), place]) if len(found) else np.zeros((0, len(FEATURES)))


#: The labelled table: pages of usual build. Within them, what stands between [[ and ]] is content.
LABELLED = (
    '<body><header><a href="/">The Daily Example</a></header><nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sports pages</a></li></ul></nav><article><h1>[[A bridge is opened]]</h1><p>[[The new bridge over the river was opened on Monday after three years of work, and hundreds of people walked across it.]]</p><p>[[It rained.]]</p></article><footer>Copyright Example Media, all rights reserved in every country</footer></body>',
    '<body><div class="menu"><a href="/">Home</a> <a href="/x">Shop</a></div><div class="ad">Buy two lamps and get one for free this week only.</div><article><h1>[[Short.]]</h1><p>[[No.]]</p><p>[[See <a href="/more">the full report of the committee</a>.]]</p></article><footer>Contact</footer></body>',
    '<body><nav><a href="/1">One</a></nav><main><h2>[[Method]]</h2><p>[[We weighed every sample twice and wrote the mean of both readings down before the next sample was taken from the box.]]</p><ul><li>[[salt]]</li><li>[[clean water]]</li></ul></main><aside><p>Read also our long series about the history of weighing in the towns along the coast.</p></aside></body>',
    '<body><div class="cookie-notice"><p>We use cookies to make this site work and to measure how it is used by you and by others.</p><button>Accept</button></div><div id="story"><p>[[The council met for the second time this year and agreed on the budget, although several members had asked for more time to read it in full.]]</p><p>[[A vote on the school follows in May, when all of the members are expected to be present again.]]</p></div><div class="footer"><a href="/imprint">Imprint</a> <a href="/terms">Terms</a></div></body>',
    '<body><div><a href="/a">Start</a> <a href="/b">Archive of older issues</a> <a href="/c">About us</a></div><div><p>[[Nobody had expected the train to arrive on time, yet it stood at the platform when the doors of the station were opened in the morning.]]</p><p>[[The driver smiled and waved, and the children on the bridge above the line waved back at him until he was gone.]]</p></div><div><a href="/n">Next</a></div><div>Share this</div></body>',
    '<body><article><header><h1>[[Winter birds]]</h1></header><p>[[Many birds stay.]]</p><section class="comments"><h3>Comments</h3><p>I have never seen so many birds in my garden as in this year, thank you for writing about them at such length!</p></section><form><label>Your name</label><p>Write a comment and send it with the button below, please be kind to the others.</p></form></article></body>',
    '<body><div id="sidebar"><h3>Popular</h3><p>The ten best walks along the lake, chosen by our readers and tested by us on two weekends.</p></div><article><p>[[One.]]</p><p>[[Two words.]]</p><blockquote>[[It is late, she said, and the lamp is low.]]</blockquote><pre>[[x = 1]]</pre></article><div class="newsletter"><p>Get our letter every Sunday morning and read it with your first cup of coffee.</p></div></body>',
    '<body><div><p>[[The recipe is an old one, and my grandmother wrote it down on the back of a letter that she had received from her sister in the south.]]</p><p>[[Stir the flour into the warm milk, add the eggs one after another, and leave the bowl alone for an hour before you begin to bake.]]</p><h2>[[Baking]]</h2><p>[[Bake it for forty minutes, then let it cool down on the table, and do not cut it before it has become quite cold inside.]]</p></div><div>Login</div><div><a href="/p">Privacy</a></div></body>',
    '<body><div class="header"><p>Example Journal, the paper for the whole valley and for all who have moved away from it</p></div><article><h1>[[Rules]]</h1><table><tr><td>[[Players]]</td><td>[[two to four]]</td></tr></table><p>[[<a href="/r">Read all the rules here</a>]]</p></article><div class="related"><a href="/q">Chess for beginners and their parents</a></div></body>',
    '<body><article><p>[[Only this.]]</p></article></body>',
    '<body><article><h1>[[Alone]]</h1><p>[[There is nothing else on this page, neither a menu above nor a line of links below, and it ends with this sentence.]]</p></article></body>',
    '<body><article><p>[[<a href="/whole">The whole paragraph is one link to the paper</a>]]</p><p>[[<a href="/2">Second link</a>]]</p><p>[[End]]</p></article><a href="/next">Next page of the list</a></body>',
    '<body><main><p>[[Yes.]]</p><p>[[<a href="/k">Key</a>]]</p></main><p><a href="/t">Terms and conditions of use</a> <a href="/i">Imprint</a></p></body>',
    '<body><p><a href="/h">Home</a> | <a href="/w">What we do</a></p><p>[[The mill has stood at the brook for three hundred years, and it still grinds the flour for the bakers of the two villages on market days.]]</p><p>[[Visitors may look at the wheel from the path, but they must keep their dogs away from the ducks.]]</p></body>',
    '<body><p>[[A letter with no frame around it, as people wrote them when the web was young and every page was made by hand in the evening.]]</p><p>[[Write to me if you have read it to the end and want to know what happened to the boat.]]</p></body>',
    '<body><div><a href="/1">Page one</a></div><div>Menu</div><div><a href="/2">Page two</a> <a href="/3">Page three</a></div></body>',
    '<body><nav>Open the menu to see all the pages of this site in the order in which they were written</nav><section>[[The snow came early, and it stayed until the end of March, so that the road over the pass was closed for nearly five months that winter.]]</section><section class="comments"><p>Nice.</p></section></body>',
    '<body><article><p>[[First part of the story, which was told to me by a man on the ferry.]]</p><div class="advert"><p>Drink more water, sold in bottles made of glass.</p></div><p>[[Second.]]</p></article><div class="share-buttons">Send it on</div></body>',
)


def training_rows() -> list[tuple]:
    """(label, *features) of every block of the labelled table."""
    out = []
    for page in LABELLED:
        found = blocks(page)
        label = [int("[[" in b.text) for b in found]
        out += [(float(y), *map(float, x)) for y, x in zip(label, features(found))]
    return out


def train(spark: SparkSession, rows: list[tuple] | None = None, depth: int = 5) -> list[tuple]:
    """The decision tree as nodes (feature, threshold, left, right, content); a leaf has feature -1.
    A value up to the threshold goes left. rows: (label, *FEATURES), the labelled table if None."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    table = spark.createDataFrame(rows or training_rows(), ["label", *FEATURES]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, maxBins=64, seed=1).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table))
    nodes: list = []

    def walk(node) -> int:
        k = len(nodes)
        nodes.append(None)
        if node.getClass().getSimpleName() == "LeafNode":
            nodes[k] = (-1, 0.0, -1, -1, node.prediction() > 0.5)
        else:
            split = node.split()
            left = walk(node.leftChild())
            nodes[k] = (split.featureIndex(), split.threshold(), left, walk(node.rightChild()), False)
        return k

    walk(model._java_obj.rootNode())
    return nodes


def predict(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    feature, threshold, left, right, content = (np.array(c) for c in zip(*nodes))
    while len(go := np.flatnonzero(feature[at] >= 0)):
        here = at[go]
        at[go] = np.where(x[go, feature[here]] <= threshold[here], left[here], right[here])
    return content[at]


def main_text(page: str | None, nodes: list[tuple]) -> str:
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, predict(nodes, features(found))) if keep) if found else ""


def extract(pages: DataFrame, nodes: list[tuple] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    small_batches(spark)
    nodes = nodes or train(spark)

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(2)):
                out = [main_text(t, nodes) for t in texts]
                cut = [batch.column(i).slice(at, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
