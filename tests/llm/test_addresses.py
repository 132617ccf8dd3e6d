"""Spanish street addresses with every way of writing the house number's sign."""

import pytest

from tidewatch.llm import p6_personal as p6


@pytest.mark.parametrize("sign", ["", "n.", "n.º ", "no ", "no. ", "nº", "n°. ", "núm. ", "num. 0", "Núm ", "número ", "numero ", "#", "# "])
@pytest.mark.parametrize("street", ["Avda. Korqua", "calle de la Sol Alta", "C/ Halhel,", "Paseo del Prado"])
def test_house_number_signs(street, sign):
    address = f"{street} {sign}38"
    text = f"vive en {address}, Cakor"
    assert p6.redacted(text, p6.spans(text)) == "vive en <ADDRESS>, Cakor"


def test_no_address_without_a_house_number():
    assert p6.spans("la calle tiene número oculto y la plaza Mayor no 2026x") == []
