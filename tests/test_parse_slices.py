"""Articles are parsed few at a time, whatever the size of a batch."""

from __future__ import annotations

import pandas as pd

from litgraph.sources import articles


class Captured:
    def select(self, *columns):
        return self

    def mapInPandas(self, function, schema):
        return function


def test_slices_hold_all_articles(spark):
    xml = "<article><front><article-meta><title-group><article-title>T</article-title></title-group></article-meta></front></article>"
    run = articles.parse_jats(Captured(), "body")
    out = list(run([pd.DataFrame({"article_id": [str(i) for i in range(n)], "body": [xml] * n}) for n in (450, 0, 3)]))
    assert max(map(len, out)) <= 200
    assert [i for d in out for i in d["article_id"]] == [str(i) for i in range(450)] + ["0", "1", "2"]
    assert {t for d in out for t in d["title"]} == {"T"}
