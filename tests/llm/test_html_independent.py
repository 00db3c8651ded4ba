"""Main text against the standard library's parser on the given pages, without slack: what stands inside article and outside its asides."""

from html.parser import HTMLParser

from cataloom.llm import queries as q

SMALL = "/root/testdata/sf0.01"
INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time u var wbr br img".split())
ASIDE = set("nav aside footer header form script style template noscript iframe button".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MARKS = ("ad", "ads", "advert", "cookie", "notice", "sidebar", "comments", "comment", "newsletter", "related", "menu", "promo", "share", "banner")


class Article(HTMLParser):
    """Texts of blocks inside article, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.pieces = [], [], []

    def flush(self):
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(text)
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        if tag == "br":
            self.pieces.append(" ")
        if tag not in VOID:
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().replace("-", " ").split()
            self.open.append((tag, tag in ASIDE or any(n in MARKS for n in names)))

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(aside for _, aside in self.open):
            self.pieces.append(data)


def test_op10_is_the_article_s_text(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    want = {}
    for k, page in pages.items():
        p = Article()
        p.feed(page or "")
        p.close()
        p.flush()
        want[k] = "\n".join(p.blocks)
    got = {r["page_id"]: r["text"] for r in q.queries()["op10_html_extraction"](spark, SMALL).collect()}
    assert [k for k in want if want[k] != got[k]] == [] and sum(map(bool, want.values())) > 200
