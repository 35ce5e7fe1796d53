import ipaddress

import pytest

from quirelake.llm.pii import entities, surrogate

PHONES = [
    "+15551234567", "+4915112345678", "+1 5551234567", "5551234567", "15552234567", "+33 1 23 45 67 89", "555-1234", "+1 (602) 555-5136", "+44 (0)20 7946 0958", "+49/151/12345678", "+49 (151) 1234-5678",
    "+1.602.555.5136", "+1 602‑555‑5136", "0033 1 23 45 67 89", "0049 151 12345678", "01234567890", "(602) 555-5136", "+(33) 123456789", "+358 9 1234567",
]
ADDRESSES = ["2001:db8::1", "fe80::1", "2001:0DB8:85A3:0000:0000:8A2E:0370:7334", "::ffff:10.1.2.3", "dead:beef::cafe", "2001:db8:1:2::"]
CLEAN = ["12:30:45", "std::vector", "a::b", "x[::2] and x[1::2]", "1 + 2", "+12345", "3.1415926535", "00:1a:2b:3c:4d:5e", "2024-01-15", "12345678", "1700000000", "Foo::Bar ::"]


@pytest.mark.parametrize("value", PHONES)
def test_phone_formats(value):
    for text in (value, f"Call {value}, now", f"tel:{value}.", f"({value})"):
        assert [(text[a:b], k) for a, b, k in entities(text)] == [(value, "phone")], text
    new = surrogate("phone", value, b"k")
    assert new != value and [c if not c.isdigit() else "0" for c in new] == [c if not c.isdigit() else "0" for c in value]


@pytest.mark.parametrize("value", ADDRESSES)
def test_ipv6_formats(value):
    for text in (value, f"from {value}: refused", f"addr:{value}", f"[{value}]:443", f"{value}%eth0"):
        assert [(text[a:b], k) for a, b, k in entities(text)] == [(value, "ipv6")], text
    new = surrogate("ipv6", value, b"k")
    assert ipaddress.IPv6Address(new) != ipaddress.IPv6Address(value) and len(new.split(":")) == len(value.split(":"))
    ipaddress.IPv6Address(surrogate("ipv6", value, b"k", 9))


@pytest.mark.parametrize("text", CLEAN)
def test_what_is_neither(text):
    assert entities(text) == []


def test_surrogates_of_addresses_differ():
    assert len({surrogate("ipv6", f"2001:db8::{i:x}", b"k") for i in range(16, 256)}) == 240
