"""Class names of wrappers do not decide over the text inside."""

import pytest

from panelcast.llm import mincut as M


@pytest.mark.parametrize("name", ["layout has-sidebar", "with-sidebar", "no-header", "search-content", "related-layout", "sidebar"])
def test_a_named_wrapper_does_not_empty_the_page(name):
    prose = "".join(f"<p>The town council met again on day {i}, and after a long debate the new bridge was approved by most members.</p>" for i in range(4))
    got = M.main_text(f"<body><nav><a>Home</a></nav><div class='{name}'><article>{prose}</article></div></body>", M.UNTRAINED)
    assert "day 0" in got and "day 3" in got and "Home" not in got
    if name != "sidebar":
        assert "day 2" in M.main_text(f"<body><nav><a>Home</a></nav><div class='{name}'>{prose}</div></body>", M.UNTRAINED)
