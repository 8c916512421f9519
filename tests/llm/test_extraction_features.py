from __future__ import annotations

from pricetrail.llm import extraction


def test_marks_and_digits_late_in_a_block_count():
    late, plain = "word " * 60 + "© " + "1234567890 " * 60, "word " * 200
    page = f"<html><body><div><p>{late}</p></div><div><p>{plain}</p></div></body></html>"
    one, two = extraction.sequence(extraction.blocks(page))
    assert "copyright" in one and "digits 2" in one
    assert "copyright" not in two and "digits 0" in two
