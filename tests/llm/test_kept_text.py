"""Article text that markup around it must not take away."""

import pytest

from loomspan.llm.html_text import main_text

TEXT = "The river rose.\nIt fell again."
PARTS = "<p>The river rose.</p><p>It fell again.</p>"


@pytest.mark.parametrize("attribute", ['class="overflow-hidden"', "style='overflow:hidden'", 'data-state="not hidden"', 'title="display:none"', 'aria-hidden="false"'])
def test_words_in_attributes_hide_nothing(attribute):
    assert main_text(f"<body><div {attribute}>{PARTS}</div></body>") == TEXT


@pytest.mark.parametrize("attribute", ["hidden", 'hidden=""', 'aria-hidden="true"', 'style="color:red; display: none"'])
def test_hidden_elements_are_left_out(attribute):
    assert main_text(f"<body><div {attribute}>Not shown.</div><div>{PARTS}</div></body>") == TEXT


@pytest.mark.parametrize("tag", ['<svg width="1"/>', "<math/>", '<object data="x"/>', "<svg>", "<canvas>", '<iframe src="x"/>'])
def test_empty_and_unclosed_forms_cut_nothing(tag):
    assert main_text(f"<body>{tag}{PARTS}</body>") == TEXT


def test_embedded_content_is_left_out():
    assert main_text(f"<body><svg><text>a</text></svg><script>var a = '<p>';</script>{PARTS}<script>cut off") == TEXT


def test_links_of_an_article_stay():
    items = "".join(f"<li><a href=x>\n      Item {k}\n    </a></li>" for k in range(5))
    assert main_text(f"<body><article>{PARTS}<ul>{items}</ul><p>End.</p></article></body>") == TEXT + "".join(f"\nItem {k}" for k in range(5)) + "\nEnd."


def test_white_space_in_links_weighs_nothing():
    lines = "".join(f"<p>No {k} <a href=x>          wide            </a></p>" for k in range(4))
    assert main_text(f"<body>{lines}</body>") == "\n".join(f"No {k} wide" for k in range(4))
