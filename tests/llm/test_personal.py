import pytest

from lumenry.llm import personal

FINDER = personal.Finder()


def found(text):
    return [(k, text[a:b]) for a, b, k in FINDER.find(text)]


GENERAL = [
    ("My number is +44 20 7946 0123.", [("phone", "+44 20 7946 0123")]),
    ("Reach 0800 123 4567 today", [("phone", "0800 123 4567")]),
    ("It rang twice (+49 30 1234567), then 0044 20 7946 0123", [("phone", "+49 30 1234567"), ("phone", "0044 20 7946 0123")]),
    ("IBAN DE89370400440532013000 please", [("id_number", "DE89370400440532013000")]),
    ("IBAN DE89 3704 0044 0532 0130 00, thanks", [("id_number", "DE89 3704 0044 0532 0130 00")]),
    ("My card 4111 1111 1111 1111 was charged", [("id_number", "4111 1111 1111 1111")]),
    ("I am Robert Fisher and I waited", [("person_name", "Robert Fisher")]),
    ("mailto:ann.b@example.org", [("email", "ann.b@example.org")]),
]
NONE = [
    "IBAN DE89370400440532013001 please", "My card 4111 1111 1111 1112 was charged", "passport 000000000", "I am Very Happy", "Price 1.234.567,89 and +5 % or +12 items",
    "see https://shop.example.org/p/+44-207-222-33311", "order 2025-936-6432, 12345678 steps, v2.1.0+44",
]


@pytest.mark.parametrize("text,want", GENERAL)
def test_general_anchors(text, want):
    assert found(text) == want


@pytest.mark.parametrize("text", NONE)
def test_what_fails_validation_is_none(text):
    assert found(text) == []


@pytest.mark.parametrize("size", [79, 80, 81, 90, 3000])
def test_local_parts_of_any_length_are_whole(size):
    text = "Mail " + "x" * size + "@mail.example.org now"
    assert found(text) == [("email", "x" * size + "@mail.example.org")]


@pytest.mark.parametrize("size", [10, 100, 400])
def test_long_addresses_are_whole(size):
    street = "14 Old Old Mill" + "x" * size + " Lane, Dunford"
    assert found(f"Send it to {street} please.") == [("street_address", street)]


def test_many_pieces_in_one_text():
    text = " ".join(f"a{k}@mail.example.org" for k in range(5000))
    assert len(found(text)) == 5000


def test_check_digits():
    assert personal.is_card("4111-1111-1111-1111") and not personal.is_card("4111 1111 1111 1112") and not personal.is_card("0000 0000 0000 0000")
    assert personal.is_account("GB82 WEST 1234 5698 7654 32") and not personal.is_account("GB82 WEST 1234 5698 7654 33") and not personal.is_account("GB82")
