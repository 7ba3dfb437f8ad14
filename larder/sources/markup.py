"""Elements of pages by a tree parser, for markup that nests deeper than a regular expression can follow."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: tag, attribute, value: of a class one of its words, of others the whole; None: any.
Rule = tuple[str | None, str | None, str | None]

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that ends where the next of its kind begins, unless one of these lists or blocks stands between.
ENDS_ITSELF = {"li": {"ul", "ol"}, "p": {"div", "section", "article", "li", "td", "body"}, "td": {"tr", "table"}, "tr": {"table"}}
#: Blocks, before which a paragraph ends.
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
SILENT = ("script", "style")


def fits(rule: Rule, tag: str, attrs: dict[str, str | None]) -> bool:
    t, name, value = rule
    if t is not None and t != tag:
        return False
    if name is None:
        return True
    if name not in attrs:
        return False
    return value is None or (value in (attrs[name] or "").split() if name == "class" else attrs[name] == value)


class Elements(HTMLParser):
    """What each rule finds, in the order of the page: (name, number of the element it is in, text).  A name "a/b" is b within an a."""

    def __init__(self, rules: dict[str, Rule]):
        super().__init__(convert_charrefs=True)
        self.rules = rules
        self.open: list[tuple[str, list[int]]] = []
        self.found: list[tuple[str, int | None, list[str]]] = []
        self.words: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        for ended in {tag, "p"} if tag in BLOCKS else {tag}:
            for k in range(len(self.open) - 1, -1, -1):
                if ended not in ENDS_ITSELF or self.open[k][0] in ENDS_ITSELF[ended]:
                    break
                if self.open[k][0] == ended:
                    del self.open[k:]
                    break
        around = [i for _, own in self.open for i in own]
        own = []
        for name, rule in self.rules.items():
            outer, _, _ = name.rpartition("/")
            within = next((i for i in reversed(around) if self.found[i][0] == outer), None)
            if (not outer or within is not None) and fits(rule, tag, dict(attrs)):
                own.append(len(self.found))
                self.found.append((name, within, []))
        self.open.append((tag, own))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if text and not any(tag in SILENT for tag, _ in self.open):
            self.words.append(text)
            for _, own in self.open:
                for i in own:
                    self.found[i][2].append(text)


def elements(html: str | None, rules: dict[str, Rule]) -> tuple[list[tuple[str, int | None, str]], str]:
    """The elements found, and the text of the whole page."""
    p = Elements(rules)
    p.feed(html or "")
    p.close()
    return [(name, within, " ".join(text)) for name, within, text in p.found], " ".join(p.words)


def items(found: list[tuple[str, int | None, str]], item: str, parts: tuple[str, ...]) -> list[dict[str, str]]:
    """Each item with the first text of each of its parts, empty where it has none."""
    out = {i: dict.fromkeys(parts, "") for i, (name, _, _) in enumerate(found) if name == item}
    for name, within, text in found:
        outer, _, part = name.rpartition("/")
        if outer == item and part in parts and not out[within][part]:
            out[within][part] = text
    return list(out.values())


def over_pages(pages: DataFrame, key: str, rules: dict[str, Rule], schema: str, make) -> DataFrame:
    """pages(key, html) -> (key, what ``make`` gives of a page's elements and text)."""
    names = [x.split()[0] for x in schema.split("; ")]
    spec = ", ".join(schema.split("; "))

    def run(batches):
        for batch in batches:
            rows = [make(*elements(h, rules)) for h in batch.column("html").to_pylist()]
            columns = [pa.array([r[n] for r in rows], _type(x.split(maxsplit=1)[1])) for n, x in zip(names, schema.split("; "), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, *names])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, F.col("html").cast("string").alias("html")).mapInArrow(run, f"{key} {kind}, {spec}")


def _type(name: str) -> pa.DataType:
    return pa.list_(pa.string()) if name == "array<string>" else pa.string()
