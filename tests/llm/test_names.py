"""Names that no list holds, in sentences of everyday use, and capitals that are no persons."""

from tidewatch.llm import p6_personal as p6

UNLISTED = {
    "Fiona Gallagher": ("Please contact {} before noon.", "{} can be reached at +44 20 7946 0018.", "It was signed by {} last week.", "name: {}"),
    "Vikram Mehta": ("We met our accountant {} on Monday.", "Call {} on +1 415 555 0132 today.", "The parcel was addressed to {} in error."),
    "Gregory Hurst": ("Ask for {} at the desk.", "Dear {}, your order is late.", "The form lists {} with passport 123456789."),
    "Станислав Громов": ("Нашего бухгалтера зовут {}.", "Звоните +7 916 555-01-23, {} ответит.", "Договор подписал директор {}."),
    "Лукерья Дробышева": ("Её фамилия и имя: {}.", "Клиент {} просил перезвонить.", "получатель {}, тел. +7 916 555-01-24"),
    "Ярема Кобилянський": ("Нашого клієнта звати {}.", "Запитайте {} у приймальні.", "Власник {} не відповідає."),
    "Amélie Rousseau": ("Demandez Mme {} au guichet.", "Le titulaire est {}.", "Écrivez à Madame {} demain."),
    "Thorben Wiesinger": ("Sprechen Sie mit Herrn {} darüber.", "Unser Kunde {} hat bestellt.", "Inhaber: {}, Tel. +49 30 901820"),
    "Rosaura Quintanilla": ("Pregunte por la señora {} en recepción.", "La titular {} no contesta.", "Llame al +34 600 123 456 y hable con {} hoy."),
    "Priyanka Deshmukh": ("Our lawyer {} will answer.", "The file mentions {}, passport no 123456789.", "registered to {} since May"),
}
NOBODY = (
    "The group Dark Harbour published a statement.",
    "We saw Cobalt Strike and Silent Locker 3.2 on the servers of Blue River.",
    "Die Firma Nordische Wolke hat den Angriff gemeldet.",
    "Группа Чёрный Лебедь заявила о взломе.",
    "Our team at Green Valley patched Exchange Server over the weekend.",
    "El banco Nuevo Horizonte no respondió.",
)


def test_unlisted_names_are_found():
    cases = [(frame.format(name), name) for name, frames in UNLISTED.items() for frame in frames]
    assert not {p6.fold(w) for name in UNLISTED for w in name.split()} & p6.GIVEN_SET
    hit = [any(k == "name" and name in text[s:e] for s, e, k in p6.spans(text)) for text, name in cases]
    missed = [c for c, h in zip(cases, hit) if not h]
    assert sum(hit) / len(hit) >= 0.9, missed


def test_capitals_are_not_persons():
    assert [t for t in NOBODY if any(k == "name" for *_, k in p6.spans(t))] == []


def test_luhn_numbers_need_a_naming_word():
    assert p6.spans("social insurance: 500 456 108") == [] and p6.luhn("500456108")
    assert [k for *_, k in p6.spans("tax id 500 456 108 on file")] == ["national_id"]
    assert [k for *_, k in p6.spans("identity card 8001015009087 on file")] == ["national_id"]
    assert p6.spans("ticket 500 456 108") == []
