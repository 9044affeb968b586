"""Cases in which many texts or windows are within reach of one another."""

import random

from test_models import similar_classes


def test_dense_groups_lose_no_near_duplicate(spark):
    """Texts that share long boilerplate: twins over 0.8, all others under it, and all within reach of one another."""
    from grainline.llm import simhash

    r, rows = random.Random(3), []
    common = [f"c{r.random()}" for _ in range(404)]
    for k in range(150):
        own = [f"w{r.random()}" for _ in range(60)]
        rows += [(2 * k, " ".join(common + own)), (2 * k + 1, " ".join(common + own[:34] + [f"v{r.random()}" for _ in range(26)]))]
    first = similar_classes(rows)
    assert len({i for i, c in first.items() if i == c}) < 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id for x in simhash.deduplicated(docs).collect()}
    want = {i for i, c in first.items() if i == c}
    assert got >= want and len(got - want) <= 2


def test_items_that_list_like_quantities(spark):
    from grainline.llm import decontamination

    item = "Tom reads {} pages on Monday, {} pages on Tuesday, {} pages on Wednesday. How many pages does {} read in the whole"
    b = spark.createDataFrame([(0, item.format(5, 7, 9, "he"))], "item_id long, text string")
    texts = [
        item.format(5, 7, 9, "he"), "Before it stands more. " + item.format(5, 7, 9, "he") + " and after it.", item.format(15, 27, 39, "he"), item.format(5, 7, 9, "he").replace("Tuesday", "a dull Tuesday"),
        item.format(5, 7, 9, "he") + " and 11 pages on Friday, 12 pages on Saturday", "On Monday there are 5 pages and on Tuesday 7 pages to be read by all of us.",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.share for r in decontamination.matches(d, b).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[0] == got[1] == 1.0
