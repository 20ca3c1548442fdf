"""Benchmark items that documents hold with other line breaks, quotes, names and numbers."""

import pytest

from loomspan.llm.decontaminate import contaminated

ITEM = "Anna has 1,000 apples and Peter Smith gives her 3.5 kg of plums on the way to town. How many does Anna sell to Mary?"
SHORT = "In the morning the farmer Anna sold all of her apples to Peter for a low price"

CHANGED = {
    "other line breaks": (ITEM, ITEM.replace("and Peter", "and\nPeter").replace("does Anna", "does\nAnna")),
    "quotes": (ITEM, ITEM.replace("Peter Smith", '"Peter Smith"').replace("to Mary", 'to "Mary')),
    "name at the start of a sentence": (SHORT.replace("In the morning the farmer ", ""), SHORT.replace("In the morning the farmer Anna", "Maria")),
    "other numbers": (ITEM, ITEM.replace("1,000", "500").replace("3.5", "4")),
    "name of one word": (ITEM, ITEM.replace("Peter Smith", "John")),
    "one inner word": (SHORT, SHORT.replace("apples", "pears")),
    "one inner word more": (SHORT, SHORT.replace("all of", "nearly all of")),
    "names alone": ("Anna Peter, Mary, John, Paul, Ruth, Sara, Hugo", "Anna Peter, Mary, John, Paul, Ruth, Sara, Hugo"),
}


@pytest.mark.parametrize("case", CHANGED)
def test_changed_items_are_found(spark, case):
    item, text = CHANGED[case]
    docs = spark.createDataFrame([(1, "some words come first. " + text + " and some come after it.")], "doc_id long, text string")
    assert contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).count() == 1


def test_other_texts_are_left_alone(spark):
    texts = ["Ida Otto, Emil, Karl, Nina, Vera, Lena, Olaf", "In the morning the farmer Anna went to town and came home for a low price", "Anna has 1,000 apples. Peter Smith has none of them."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(5, ITEM), (6, SHORT), (7, CHANGED["names alone"][0])], "item_id long, text string")
    assert contaminated(docs, items).count() == 0
