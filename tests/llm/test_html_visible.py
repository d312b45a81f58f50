"""Rows without a table, formulas, drawings and fallback texts."""

import pytest

from reviewlake.llm import html_text


@pytest.mark.parametrize("page, text", [
    ("<tr><td>a</td></tr>", "a"),
    ("<p>x</p><tr><td>a<td>b<tr><th>c</tr>y", "x\n\na | b\nc\ny"),
    ("<table><tr><td>a</table><tr><td>b</td></tr>", "a\n\nb"),
    ("<div><tr>loose<td>a</td></tr></div>", "loose\na"),
    ("x <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> y", "x a=2 y"),
    ("<object data=x><param name=a>fallback <b>text</b></object>", "fallback text"),
    ("<svg><title>no</title><style>no</style><g>no<text>one</text><text x='1'><tspan>two</tspan></text></g></svg>end", "one two end"),
    ("<svg><title/><desc/><circle/><text>seen</text></svg>", "seen"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"),
    ("<svg><path d='x'><p>after an open drawing", "after an open drawing"),
    ("<svg hidden><text>no</text></svg><svg><g><svg><g><div>yes</div>", "yes"),
])
def test_visible_text_is_kept(page, text):
    assert html_text.render(page) == text
