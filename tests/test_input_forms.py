"""Forms of input that the given tables don't hold."""

import pytest

from trialloom.operators import nested


@pytest.mark.parametrize("encoding", ["gb18030", "shift_jis", "big5", "euc-kr", "utf-8", "utf-16", "iso-8859-1"])
def test_xml_is_read_in_the_encoding_it_declares(encoding):
    word = {"iso-8859-1": "é", "euc-kr": "한"}.get(encoding, "中")
    data = f'<?xml version="1.0" encoding="{encoding}"?>\n<a><b>{word}</b></a>'.encode(encoding)
    assert nested.parse_xml(data).findtext("b") == word


def test_bytes_that_are_not_as_declared_are_no_xml():
    head = b'<?xml version="1.0" encoding="gb18030"?>'
    assert nested.parse_xml(head + b"<a>\xff</a>") is None
    assert nested.parse_xml(head + b"<a>") is None
    assert nested.parse_xml(b'<?xml version="1.0" encoding="none-such"?><a/>') is None
