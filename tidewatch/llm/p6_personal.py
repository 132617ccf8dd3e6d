"""Personal information inside free text (problem 6).

Method: regular expressions propose spans, each with a first score; checksum validators (mod-97, mod-11, Luhn ...) raise it and
the words around a span raise or lower it; spans at ``ACCEPT`` or more are replaced by typed placeholders such as ``<EMAIL>``.
Numbers without a shape of their own need a validator or a word that names them, or stand in a list line with other personal
data; the number kinds that carry a Luhn digit (nine digits in threes, thirteen digits with a date) need a naming word as well. Words
such as ``ticket``, ``session`` or ``build`` before a number speak against it.

Names. Two or three words are a person by what speaks for it together (``name_score``): capitals where they mean something, a
naming word before them, other personal data in the same stretch of a sentence, a frequent given name, the ending of a family
name; words of organisations, versions and function words speak against it. None of these is needed by itself, in particular
no list has to hold the name. Initials, patronymics, named fields, list lines and Chinese and Persian names have forms of their own.

Kinds: email, phone, national_id, address, name. Logins at bare IP addresses are no e-mail addresses; handles are no names.
Of overlapping spans the better scored one holds, of equal ones the longer. Null stays null, empty stays empty; texts of any
length are taken whole.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.tables import table

ACCEPT = 0.5
KINDS = ("email", "national_id", "phone", "address", "name")

#: Given names that public statistics list among the most frequent, for each language (fixed values). They only add to a score.
GIVEN = (
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen "
    "александр елена сергей татьяна владимир наталья андрей ольга алексей ирина дмитрий анна николай светлана иван мария евгений екатерина михаил галина "
    "олександр олена сергій тетяна володимир наталія андрій марія микола ганна юрій людмила віктор оксана василь надія іван ольга "
    "peter maria hans ursula michael monika thomas petra andreas elisabeth wolfgang sabine klaus renate jürgen helga günter karin stefan brigitte "
    "marie jean nathalie michel isabelle pierre sylvie philippe catherine alain martine nicolas christine christophe françoise patrick valérie laurent sandrine "
    "antonio carmen josé ana manuel isabel francisco laura juan lucía javier marta carlos cristina miguel elena rafael pilar pedro dolores "
    "محمد فاطمه علی زهرا حسین مریم مهدی معصومه رضا سکینه حسن زینب احمد رقیه عباس لیلا اکبر خدیجه ابوالفضل نرگس"
).split()
#: Chinese family names, the most frequent ones (fixed values).
FAMILY_HAN = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤谌"

LETTER = r"[^\W\d_]"
WORD = rf"{LETTER}+(?:[-'’]{LETTER}+)*"

LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
LOCAL = r"(?<![\w.+@＠-])[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9_])?"
DOT = r"(?:\.|\[\.\]|\s?[\[({](?:dot|точка)[\])}]\s?|\s\.\s|\sdot\s)"
EMAIL = re.compile(
    rf"{LOCAL}(?:[@＠]|\s?[\[({{](?:at|@)[\])}}]\s?|\s[@＠]\s|\sat\s(?=[\w-]+(?:\s?[\[({{]dot|\sdot\s)))(?:{LABEL}{DOT})+[A-Za-z]{{2,}}(?![\w@])", re.IGNORECASE
)

NUMBER = re.compile(r"(?<![\w.,/#:@+-])(?:\+|00(?=[1-9]))?\(?\d[\d()./ \t-]{6,20}\d(?![\w@]|[.,/:-]\d)|(?<=[=:;|])\+?\(?\d[\d()./ -]{6,20}\d(?![\w@]|[.,/:-]\d)")
PHONE_SHAPES = [
    (re.compile(r"\+\d{1,3}[ (.\-]*\d[\d ().\-]{6,16}"), 0.8),
    (re.compile(r"00[1-9]\d{0,2}[ \-]\(?\d{1,4}\)?[ \-]?\d[\d \-]{4,10}"), 0.7),
    (re.compile(r"[178][ \-(]{1,2}\d{3}[ \-)]{1,2}\d{3}[ \-]?\d{2}[ \-]?\d{2}"), 0.7),
    (re.compile(r"\(\d{3}\) ?\d{2,3}-\d{2}-?\d{2}"), 0.7),
    (re.compile(r"\d{3}([.\-])\d{3}\1\d{4}"), 0.7),
    (re.compile(r"0\d(?:([ .])\d\d)(?:\1\d\d){3}"), 0.7),
    (re.compile(r"0\d{2,4}[ \-]\d{3,5}[ \-]\d{3,4}"), 0.65),
    (re.compile(r"0\d{4} \d{6}"), 0.65),
    (re.compile(r"0\d{1,4}/\d{3,9}(?:[ \-]\d{2,5})?"), 0.65),
    (re.compile(r"0\d{2,3}-\d{7,8}"), 0.55),
]
PHONE_WEAK = re.compile(r"1\d{10}|\d{3}-\d{3}-\d{3}|[78]\d{10}|0\d{9,10}|[67]\d{8}")
PHONE_WORDS = re.compile(r"(?:phone|mobile|msisdn|gsm|\bcell|\bcall|\bring\b|tel\b|тел\b|телефон|звони|номеру|моб\b|móvil|movil|handy|anrufen|appelez|portable|llame|llama|تلفن|شماره تماس|تماس|电话|手机|致电|拨打)\W*(?:\w+\W+){0,2}$", re.IGNORECASE)

ID_SHAPES = [
    (re.compile(r"(?<![\w-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])"), 0.6, None),
    (re.compile(r"(?<!\w)[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?!\w)"), 0.7, None),
    (re.compile(r"(?<![\w.-])(?:серия|серія)?\s?\d\d ?\d\d\s?(?:№|N|номер)\s?\d{6}(?!\w)", re.IGNORECASE), 0.8, None),
    (re.compile(r"(?<![\w.+()-])(?<!\d )\d\d \d\d \d{6}(?!\w)"), 0.6, None),
    (re.compile(r"(?<![\w-])\d{3}-\d{3}-\d{3} \d{2}(?!\w)"), 0.7, "snils"),
    (re.compile(r"(?<![\w-])\d{3}-\d{6}-\d(?!\w)"), 0.6, "mod11"),
    (re.compile(r"(?<!\w)[А-ЯІЇЄҐ]{2} ?№? ?\d{6}(?!\w)"), 0.7, None),
    (re.compile(r"(?<!\w)\d{8}-?[A-ZÑ](?!\w)"), 0.6, "dni"),
    (re.compile(r"(?<!\w)[XYZ]-?\d{7}-?[A-ZÑ](?!\w)"), 0.7, "dni"),
    (re.compile(r"(?<![\w+])\d \d\d \d\d \d\d \d{3} \d{3} \d\d(?!\w)"), 0.7, "mod97"),
    (re.compile(r"(?<![\w.,/#:@+=-])\d{17}[\dXx](?!\w)|(?<=[=:;|])\d{17}[\dXx](?!\w)"), 0.4, "mod11_2"),
    (re.compile(r"(?<![\w.,/#:@+-])\d{15}(?!\w)"), 0.3, "mod97"),
    (re.compile(r"(?<![\w.,/#:@+-])\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{7}(?!\w)"), 0.15, "luhn"),
    (re.compile(r"(?<![\w.,/#:@+-])\d{3}([ -])\d{3}\1\d{3}(?![\w-])"), 0.1, "luhn"),
    (re.compile(r"(?<![\w.,/#:@+-])\d{12}(?![\w,.]\w|\w)"), 0.1, None),
    (re.compile(r"(?<![\w.,/#:@+-])\d{10}(?![\w,.]\w|\w)"), 0.1, "mod11"),
    (re.compile(r"(?<![\w.,/#:@+-])\d{9}(?![\w,.]\w|\w)"), 0.1, None),
]
#: German identity cards have letters among the digits, all others hold a cluster of digits.
ID_MIXED = re.compile(r"(?<!\w)[CFGHJKLMNPRTVWXYZ]\d(?=[0-9CFGHJKLMNPRTVWXYZ]*\d{2})[0-9CFGHJKLMNPRTVWXYZ]{7,8}(?!\w)")
CLUSTER = re.compile(r"\d[\d().\-/ \t№Nномер]{4,24}\d")
ID_WORDS = re.compile(
    r"(?:passport|паспорт\w*|\bssn|social security(?: number)?|tax id|\bnino|\bid_no|\bnid|\bdni|\bnie|\bnif|\bdoc|documento|документ\w*|снилс|\bинн|рнокпп|\bіпн|\bipn|код|ausweis\w*|personalausweis|steuer\w*|identité|sécurité sociale|numéro d.identité|کد ملی|گذرنامه|身份证号?|护照号?|national id|identity card)\W*(?:\w+\W+){0,1}$",
    re.IGNORECASE,
)
AGAINST = re.compile(r"(?:session|ticket|range|build|batch(?: no)?|isbn\S*(?: code)?|order|port|upd|\bid|сборка|збірка|заявка|тикет|версия|version|versión|номер заказа|stand|compilación|caso|工单|درخواست|invoice no|bitcoin|block|tx)\s*[#№:=]?\s*$", re.IGNORECASE)

ADDRESS = [
    (re.compile(rf"(?<!\w)(?:flat \d+\w?, )?\d{{1,4}}[a-z]? (?:{WORD} ){{1,3}}(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|close|court|square|boulevard|blvd|way|terrace)\b\.?(?:,? apt\.? \d+)?", re.IGNORECASE), 0.7),
    (re.compile(rf"(?<!\w)(?:ул\.|улица|пер\.|переулок|просп\.|пр-т|проспект|шоссе|бульвар|б-р|наб\.|набережная|вул\.|вулиця|провулок|пров\.|просп\.|площа|площадь)\s+{WORD}(?:\s{WORD})?,?\s+(?:(?:д\.|дом|буд\.|будинок)\s*)?\d+(?:[-/]\d+|\s?{LETTER})?(?!\w)", re.IGNORECASE), 0.8),
    (re.compile(rf"(?<!\w)\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|av\.|impasse|bd|boulevard|allée|place|chemin|quai|route|cours)\s+(?:(?:de|du|des|la|le|les)\s+|d'|l')*{WORD}", re.IGNORECASE), 0.8),
    (re.compile(rf"(?<!\w)(?:calle|c/|avda\.?|avenida|plaza|pza\.?|paseo|camino|carrer)\s*(?:(?:de|del|la|las|los)\s+)*{WORD}(?:\s{WORD})?,?\s+(?:(?:n\.?[ºo°]\.?|n\.|n[úu]m(?:ero)?\.?|#)\s*)?\d{{1,4}}(?!\w)", re.IGNORECASE), 0.8),
    (re.compile(rf"(?<!\w){LETTER}{{2,}}(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer)\s\d{{1,4}}\s?[a-z]?(?!\w)", re.IGNORECASE), 0.8),
    (re.compile(rf"(?<!\w)(?:am|an der|auf dem|im|zum)\s{LETTER}{{3,}}\s\d{{1,4}}\s?[a-z]?(?=,)", re.IGNORECASE), 0.7),
    (re.compile(r"(?:خیابان|کوچه|بلوار|میدان|بزرگراه)\s+\w+(?:\s\w+)?،?\s+(?:پلاک|شماره)\s*[\d۰-۹]+"), 0.8),
    (re.compile(r"(?:(?![是在到址寄])[一-鿿]){1,8}(?:路|街|道|巷|弄|胡同)\s?\d+\s?号(?:\d+室)?"), 0.8),
]

#: One of these stands in a text that has the address form of the same place in the list.
ADDRESS_HINTS = (
    ("street", " st.", " st,", " road", " rd", " lane", " ln", " ave", " drive", " dr", " close", " court", " square", " boulevard", " blvd", " way", " terrace"),
    ("ул.", "улиц", "пер.", "переул", "просп", "пр-т", "шоссе", "бульвар", "б-р", "наб", "вул", "пров", "площ"),
    ("rue ", "avenue ", "av. ", "impasse ", "bd ", "boulevard ", "allée ", "place ", "chemin ", "quai ", "route ", "cours "),
    ("calle", "c/", "avda", "avenida", "plaza", "pza", "paseo", "camino", "carrer"),
    ("straße ", "strasse ", "str. ", "weg ", "gasse ", "allee ", "platz ", "ring ", "damm ", "ufer "),
    ("am ", "an der ", "auf dem ", "im ", "zum "),
    ("خیابان", "کوچه", "بلوار", "میدان", "بزرگراه"),
    ("号",),
)
KEY_HINTS = ("name", "fio", "фио", "имя", "піб", "ім'я", "nombre", "nom", "holder", "owner", "kunde", "client", "customer", "inhaber", "titular", "نام", "姓名")
PATRONYMIC_HINTS = ("ович", "евич", "ьич", "овна", "евна", "ична")
HAN = re.compile("[一-鿿]")
ACCENT = re.compile("[À-ɏ]")

KEY_NAME = re.compile(r"(?:^|[\s{,;|\"'])(?:full_?name|name|fio|фио|имя|піб|ім'я|nombre|nom|holder|owner|kunde|client|customer|inhaber|titular|نام|姓名)[\"']?\s*(?:=|:|->)\s*[\"']?([^\n;|\t\"=]{2,60})", re.IGNORECASE)
PATRONYMIC = re.compile(rf"(?<!\w){LETTER}{{3,}} {LETTER}{{3,}} {LETTER}+(?:ович|евич|ьич|овна|евна|ична|инична)(?!\w)", re.IGNORECASE)
INITIALS = re.compile(rf"(?<![\w.])(?:([A-ZА-ЯІЇЄҐÀ-Þ]{LETTER}{{3,}}),? [A-ZА-ЯІЇЄҐÀ-Þ]\.(?: ?[A-ZА-ЯІЇЄҐÀ-Þ]\.)?|[A-ZА-ЯІЇЄҐÀ-Þ]\. ?(?:[A-ZА-ЯІЇЄҐÀ-Þ]\. ?)?([A-ZА-ЯІЇЄҐÀ-Þ]{LETTER}{{3,}}))(?!\w)")
SURNAME_END = re.compile(r"(?:ов|ев|ёв|ин|цев|ский|ской|енков|ухин|ова|ева|ина|ская|енко|чук|ишин|ець|ук|юк|by|ham|wick|ley|ford|son|ton|ez|ero|uela|ano|ette|ault|ier|ard|meier|mayer|hausen|brück|ling|mann|berger)$", re.IGNORECASE)
#: Words that a person's name follows, in the eight languages: those that hardly have another use, and those that often have.
NAMING = re.compile(
    r"(?<!\w)(?:(?:full |first |last )?names?(?: is| of)?|named|called|call|phone|contact(?:ed|ing)?|ask(?:ed|ing)? for|(?:speak|spoke|talk|talked|write|wrote) (?:to|with)|(?:sent|shipped|delivered|addressed|issued|registered) to|"
    r"(?:owned|signed|written) by|mr\.?|mrs\.?|ms\.?|miss|dr\.?|prof\.?|attn\.?|dear|employee|manager|director|accountant|colleague|customer|client|patient|doctor|lawyer|teacher|"
    r"имя|имени|фамили[яейю]+|зовут|звать|спроси\w+|господин\w*|госпож\w*|г-н\w*|г-ж\w*|граждан\w+|клиент\w*|сотрудни\w+|директор\w*|бухгалтер\w*|владел\w+|получател\w+|врач\w*|"
    r"ім['’]я|імені|прізвищ\w+|звати|запита\w+|пан[аіу]?|пані|громадян\w+|клієнт\w*|власник\w*|отримувач\w*|співробітни\w+|"
    r"namens?|heißt|herrn?|frau|kundin|kunde|inhaber\w*|mitarbeiter\w*|ansprechpartner\w*|ausgestellt auf|ging an|geht an|"
    r"nom(?: de)?|nommée?|appel(?:ée?|ez)|demand(?:ez|er)|m\.|mme|mlle|monsieur|madame|docteur|titulaire|employée?|destinataire|contact(?:ez|er)|"
    r"nombre(?: de)?|llamad[oa]|se llama|pregunt\w+ por|señora?|sra?\.?|don|doña|cliente|titular|destinatari[oa]|emplead[oa]|contact\w+ (?:a|con)|"
    r"نام|سراغ|متعلق به|آقای|خانم|دکتر|مشتری|کارمند)[\s:«\"'-]*$",
    re.IGNORECASE,
)
NAMING_WEAK = re.compile(
    r"(?<!\w)(?:belongs? to|gehört|appartient à|pertenece a|принадлежит|належить|shows?|lists?|mentions?|met|with|by|to|это|есть|указан\w*|значится|є|це|вказано|für|von|nach|an|steht|ist|pour|par|montre|mentionne|est|figura|muestra|por|para|es)[\s:«\"'-]*$", re.IGNORECASE
)
#: Words before the name of an organisation or a place, and words within or after one.
ORGANISED = re.compile(
    r"(?<!\w)(?:at|group|gang|company|firm|bank|team|bei|gruppe|firma|unternehmen|группа|группы|компани\w+|банк\w*|фирм\w+|группировк\w+|угрупован\w+|компані\w+|chez|groupe|société|entreprise|banque|empresa|grupo|banco|server[ns]?|servers? of)\W*$",
    re.IGNORECASE,
)
ORGANISATION = re.compile(r"\b(?:inc|ltd|llc|plc|corp|gmbh|ag|group|bank|university|institute|hospital|ministry|team|ransomware|locker|street|road|avenue|market|forum)\b|^\W{0,2}v?\d+\.\d", re.IGNORECASE)
CAPITAL = "A-ZА-ЯІЇЄҐЁÀ-Þ"
CAPWORD = rf"[{CAPITAL}]{LETTER}*(?:[-'’]{LETTER}+)*"
#: Two or three words with capitals, also with a comma after the first.
CAPPED = re.compile(rf"(?<![\w@.#/_-]){CAPWORD},? {CAPWORD}(?: {CAPWORD})?(?![\w@=]|[-_./]\w)")
#: Characters on either side of other personal data within which a name counts as said together with it.
REACH = 48
SEPARATORS = frozenset(";|,\t\n:-–→")
#: Last words, and beginnings of last words, of ``NAMING`` and ``NAMING_WEAK``: a name is looked for only behind one of these.
NAMING_LAST = frozenset(
    "name names named of is called call phone contact contacted contacting for to with by mr mrs ms miss dr prof attn dear employee manager director accountant colleague customer client patient doctor lawyer teacher show shows list lists mention mentions met "
    "имя имени зовут звать это есть значится принадлежит ім'я ім’я імені звати пан пана пану пані належить є це вказано "
    "namen names heißt herr herrn frau kundin kunde auf an für von nach steht ist gehört "
    "nom de nommé nommée appelez appel appelée demandez demander m mme mlle monsieur madame docteur titulaire à employé employée destinataire contactez contacter pour par montre mentionne est "
    "nombre llamado llamada llama por señor señora sr sra don doña cliente titular destinatario destinataria empleado empleada a con figura muestra para es pertenece "
    "نام سراغ به آقای خانم دکتر مشتری کارمند".split()
)
NAMING_BEGIN = ("фамили", "спроси", "господин", "госпож", "г-н", "г-ж", "граждан", "клиент", "сотрудни", "директор", "бухгалтер", "владел", "получател", "врач", "указан", "прізвищ", "запита", "громадян", "клієнт", "власник", "отримувач", "співробітни", "inhaber", "mitarbeiter", "ansprechpartner")
NAME_HERE = re.compile(rf"({WORD},? {WORD}(?: {WORD})?)(?![@_=])")
PERSIAN_NAME = re.compile(r"(?:به نام|فایل نام|سراغ|متعلق به)\s+(\w{2,} \w{3,})\s+(?:به|با|را|از|است)")
LIST_FIELD = re.compile(rf"(?:^|(?<=[;|\t])|(?<= , ))[ ]*({WORD},? {WORD}(?: {WORD})?)[ ]*(?=$|[;|\t]| , )", re.MULTILINE)
AFTER_ID = re.compile(rf", ({WORD},? {WORD}(?: {WORD})?)")
HAN_NAME = re.compile(rf"(?:寄给了|文件里有|里有|姓名[:：]?|联系人|叫|找|名为|给)([{FAMILY_HAN}][一-鿿]{{1,2}})(?=[，,。;；、\s]|$)|(?:^|(?<=[;|\t,:=>\"]))\s*([{FAMILY_HAN}][一-鿿]{{1,2}})\s*(?=[;|\t,\"]|$)", re.MULTILINE)
NO_FAMILY = frozenset(
    "from on about in the and or at to with was is has for of by und von mit auf der die das ist hat de la el los las del en y que con es et le les des du un une est pour avec "
    "по на в во и из с от для что это не у за мы вы он она та і з від про в درباره از به در با را و که است на".split()
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """The key of a French social security number."""
    return len(digits) == 15 and (97 - int(digits[:13]) % 97) == int(digits[13:])


def mod11_2(x: str) -> bool:
    """The check character of a Chinese identity number (ISO 7064)."""
    return len(x) == 18 and "10X98765432"[sum(int(c) * (2 ** (17 - i) % 11) for i, c in enumerate(x[:17])) % 11] == x[17].upper()


def mod11(x: str) -> bool:
    """Check digit of a ten-digit Iranian, Ukrainian or Russian number."""
    d = [int(c) for c in x]
    if len(d) != 10:
        return False
    iran = sum(a * b for a, b in zip(d, range(10, 1, -1))) % 11
    ukraine = sum(a * b for a, b in zip(d, (-1, 5, 7, 9, 4, 6, 10, 5, 7))) % 11 % 10
    russia = sum(a * b for a, b in zip(d, (2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10
    return d[9] in (iran if iran < 2 else 11 - iran, ukraine, russia)


def snils(x: str) -> bool:
    d = re.sub(r"\D", "", x)
    return sum(int(c) * w for c, w in zip(d[:9], range(9, 0, -1))) % 101 % 100 == int(d[9:])


def dni(x: str) -> bool:
    x = x.replace("-", "").upper()
    number = int(x[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2"))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[number % 23] == x[-1]


VALIDATORS = {"mod97": lambda x: mod97(re.sub(r"\D", "", x)), "mod11_2": mod11_2, "mod11": lambda x: mod11(re.sub(r"\D", "", x)), "snils": snils, "dni": dni, "luhn": lambda x: luhn(re.sub(r"\D", "", x))}


def fold(word: str) -> str:
    """Lower case without Latin accents; Cyrillic letters keep theirs."""
    low = word.lower()
    if low.isascii() or not any("À" <= c <= "ɏ" for c in word):
        return low
    return "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


GIVEN_SET = frozenset(fold(w) for w in GIVEN)
TOKEN = re.compile(WORD)


def given_pairs(text: str, words: list[tuple[int, int, str]]):
    """(start, end) of a frequent given name beside another word, in either order and any case. ``words``: in lower case."""
    accents = ACCENT.search(text) is not None
    for i, (start, end, w) in enumerate(words):
        if w not in GIVEN_SET and not (accents and fold(w) in GIVEN_SET):
            continue
        if (start and text[start - 1] in "@_./") or (end < len(text) and text[end] in "@_.=" and text[end : end + 2].strip() != text[end : end + 1]):
            continue
        for j in (i + 1, i - 1):
            if 0 <= j < len(words):
                s, e, f = words[j]
                between = text[end:s] if j > i else text[e:start]
                if between in ((" ", "  ") if j > i else (" ", ", ")) and len(f) > 2 and not (e < len(text) and text[e] in "@_"):
                    yield min(s, start), max(e, end)


def line_of(text: str, at: int) -> tuple[int, int]:
    end = text.find("\n", at)
    return text.rfind("\n", 0, at) + 1, len(text) if end < 0 else end


def titled(words: str) -> bool:
    """Every word starts with a capital (or has no case), or all are in lower case."""
    first = [w[0] for w in TOKEN.findall(words)]
    return all(c.isupper() or c.lower() == c.upper() for c in first) or all(c.islower() for c in first)


def family_like(words: str) -> bool:
    parts = TOKEN.findall(words)
    return not any(w.lower() in NO_FAMILY for w in parts) and any(len(w) > 4 and SURNAME_END.search(w) for w in parts)


def name_score(text: str, start: int, end: int, beside: bool) -> float:
    """How much speaks for ``text[start:end]``, two or three words, being a person. ``beside``: other personal data is near."""
    part = text[start:end]
    words = TOKEN.findall(part)
    before, after = text[max(0, start - 40) : start], text[end : end + 24]
    if any(w.lower() in NO_FAMILY for w in words) or not titled(part) or ORGANISATION.search(part) or ORGANISATION.match(after.lstrip()):
        return 0.0
    given = any(fold(w) in GIVEN_SET for w in words)
    no_case = part[0].lower() == part[0].upper()
    family = any(len(w) > 4 and SURNAME_END.search(w) for w in words)
    if not no_case and part[0].islower() and not family:
        return 0.0
    shouted = part.isupper() and before.isupper()  # capitals say nothing among capitals
    score = 0.2 if no_case and given else 0.25 if part[0].isupper() and not shouted else 0.05
    score += 0.35 * beside + 0.3 * given + 0.15 * family
    score += 0.4 if NAMING.search(before) else 0.2 if NAMING_WEAK.search(before) else -0.35 if ORGANISED.search(before) else 0.0
    return score


def _sentence(text: str, start: int, end: int) -> tuple[int, int]:
    """The stretch around a span that stands in its line, its sentence and within reach. A full stop after a short word ends none."""
    lo, hi = line_of(text, start)
    lo, hi = max(lo, start - REACH), min(hi, end + REACH)
    for m in SENTENCE_END.finditer(text, lo, start):
        lo = m.end()
    m = SENTENCE_END.search(text, end, hi)
    return lo, m.start() if m else hi


SENTENCE_END = re.compile(rf"(?:(?<={LETTER}{{4}})|(?<=\d)|(?<=[)\]\"»]))[.!?]\s(?=[{CAPITAL}])|[。！？؟]|(?<=\d)\s(?=[{CAPITAL}]{LETTER}*\s(?:[{CAPITAL}]\S*\s)?(?![{CAPITAL}]){LETTER}+)")


def trimmed(text: str, start: int, end: int):
    """The words of a span, and without the last or the first of three."""
    words = [(m.start() + start, m.end() + start) for m in TOKEN.finditer(text[start:end])]
    if len(words) == 3:
        yield words[0][0], words[2][1]
    if len(words) >= 2:
        yield words[0][0], words[1][1]
        yield words[-2][0], words[-1][1]


def _number_spans(text: str, found: list[list]) -> None:
    for cluster in CLUSTER.finditer(text):
        lo, hi = max(0, cluster.start() - 14), cluster.end() + 6
        for shape, score, validator in ID_SHAPES:
            for m in shape.finditer(text, lo, hi):
                before = text[max(0, m.start() - 40) : m.start()]
                s = score
                if validator and VALIDATORS[validator](m.group().strip()):
                    s += 0.3
                if ID_WORDS.search(before):
                    s += 0.5
                elif AGAINST.search(before):
                    s -= 0.6
                if PHONE_WORDS.search(before):
                    s -= 0.4
                lead = len(m.group()) - len(m.group().lstrip())
                found.append([m.start() + lead, m.end(), "national_id", s])
    for m in ID_MIXED.finditer(text):
        found.append([m.start(), m.end(), "national_id", 0.6])
    for m in NUMBER.finditer(text):
        raw = m.group()
        if not 8 <= sum(c.isdigit() for c in raw) <= 15:
            continue
        before = text[max(0, m.start() - 40) : m.start()]
        s = next((v for shape, v in PHONE_SHAPES if shape.fullmatch(raw)), 0.1 if PHONE_WEAK.fullmatch(raw) else 0.0)
        if not s:
            continue
        if PHONE_WORDS.search(before):
            s += 0.5
        elif AGAINST.search(before):
            s -= 0.6
        if ID_WORDS.search(before):
            s -= 0.4
        found.append([m.start(), m.end(), "phone", s])


def _name_spans(text: str, low: str, found: list[list]) -> None:
    near = []
    for x in found:
        if x[3] >= ACCEPT:
            lo, hi = _sentence(text, x[0], x[1])
            follows = text[x[1] : x[1] + 3].strip(" ")[:1]
            if x[2] == "address" or (x[2] == "email" and not (follows in SEPARATORS or follows.islower())):
                hi = x[1]  # after a street comes a town, after a mail address often a new sentence
            near.append((lo, hi))

    def judge(start: int, end: int, from_start: bool = False) -> None:
        beside = any(lo <= start and end <= hi + 8 for lo, hi in near)
        best = max(((name_score(text, s, e, beside), e - s, s, e) for s, e in trimmed(text, start, end) if not from_start or s == start), default=(0.0, 0, 0, 0))
        if best[0] >= 0.2:
            found.append([best[2], best[3], "name", best[0]])

    words = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(low)]
    for s, e in given_pairs(text, words):
        judge(s, e)
    searched = set()
    for lo, hi in near:
        for m in CAPPED.finditer(text, lo, min(len(text), hi + 8)):
            if m.start() not in searched:
                searched.add(m.start())
                judge(m.start(), m.end())
    if any(h in low for h in PATRONYMIC_HINTS):
        for m in PATRONYMIC.finditer(text):
            found.append([m.start(), m.end(), "name", 0.9])
    if any(h in low for h in KEY_HINTS):
        for m in KEY_NAME.finditer(text):
            value = m.group(1).strip()
            if (2 <= len(TOKEN.findall(value)) <= 4 and not re.search(r"[\d@/_]", value)) or re.fullmatch(r"[一-鿿]{2,4}", value):
                found.append([m.start(1), m.start(1) + len(m.group(1).rstrip()), "name", 0.7])
    for i in range(len(words) - 2):
        w = words[i][2]
        if w in NAMING_LAST or w.startswith(NAMING_BEGIN):
            first, second = (text[s:e] for s, e, _ in words[i + 1 : i + 3])
            if first[0].isupper() or (first[0].lower() == first[0].upper() and (near or fold(first) in GIVEN_SET)) or (first[0].islower() and (SURNAME_END.search(first) or SURNAME_END.search(second))):
                here = NAME_HERE.match(text, words[i + 1][0])
                if here:
                    judge(here.start(), here.end(), True)
    for m in INITIALS.finditer(text):
        family = m.group(1) or m.group(2)
        before = text[max(0, m.start() - 40) : m.start()]
        beside = any(lo <= m.start() and m.end() <= hi for lo, hi in near)
        found.append([m.start(), m.end(), "name", 0.2 + 0.3 * bool(SURNAME_END.search(family)) + 0.3 * bool(NAMING.search(before) or NAMING_WEAK.search(before)) + 0.2 * beside])
    if "نام" in text or "سراغ" in text or "متعلق" in text:
        for m in PERSIAN_NAME.finditer(text):
            found.append([m.start(1), m.end(1), "name", 0.7])
    if HAN.search(text):
        for m in HAN_NAME.finditer(text):
            g = 1 if m.group(1) else 2
            found.append([m.start(g), m.end(g), "name", 0.7 if g == 1 else 0.35])


def _listed_spans(text: str, found: list[list]) -> None:
    """Weak spans, and fields of two or three words, in a list line that holds other personal data; names after a number."""
    strong = [x for x in found if x[3] >= ACCEPT]
    if not strong:
        return
    lines = {line_of(text, x[0]) for x in strong}
    for lo, hi in lines:
        line = text[lo:hi]
        if ";" in line or "|" in line or "\t" in line or " , " in line:
            for m in LIST_FIELD.finditer(line):
                s, e = lo + m.start(1), lo + m.end(1)
                if titled(m.group(1)) and (not m.group(1).islower() or family_like(m.group(1))) and any(lo <= y[0] < hi and (y[1] <= s or y[0] >= e) for y in strong):
                    found.append([s, e, "name", 0.55])
    for x in strong:
        if x[2] == "national_id":
            m = AFTER_ID.match(text, x[1])
            for s, e in trimmed(text, m.start(1), m.end(1)) if m else ():
                if s == m.start(1) and titled(text[s:e]) and family_like(text[s:e]):
                    found.append([s, e, "name", 0.6])
                    break
    for x in found:
        if 0 < x[3] < ACCEPT:
            lo, hi = line_of(text, x[0])
            left, right = text[max(lo, x[0] - 3) : x[0]].strip(" "), text[x[1] : min(hi, x[1] + 3)].strip(" ")
            listed = (not left or left[-1] in ";|,\t") and (not right or right[0] in ";|,\t")
            delimited = (left and left[-1] in ";|,\t") or (right and right[0] in ";|,\t")
            if listed and delimited and any(lo <= y[0] < hi and (y[1] <= x[0] or y[0] >= x[1]) for y in strong):
                x[3] += 0.45


def spans(text: str, whole: bool = False) -> list[tuple[int, int, str]]:
    """Accepted (start, end, kind), in text order, without overlaps. ``whole``: the text is one value, such as an author."""
    found: list[list] = []  # start, end, kind, score
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer stay as they are
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    if "@" in text or "＠" in text or "[at" in low or "(at" in low or " at " in low:
        for m in EMAIL.finditer(text):
            if not re.search(r"https?://\S*$", text[max(0, m.start() - 60) : m.start()]):
                found.append([m.start(), m.end(), "email", 1.0])
    _number_spans(text, found)
    for (shape, score), hints in zip(ADDRESS, ADDRESS_HINTS):
        if any(h in low for h in hints):
            for m in shape.finditer(text):
                found.append([m.start(), m.end(), "address", score])
    _name_spans(text, low, found)
    if whole:
        x = text.strip()
        if re.fullmatch(rf"{WORD} {WORD}", x) and all(w[0].isupper() and not w.isupper() for w in TOKEN.findall(x)):
            found.append([text.index(x), text.index(x) + len(x), "name", 0.55])
    if not found:
        return []
    _listed_spans(text, found)
    rank = {k: i for i, k in enumerate(KINDS)}
    out: list[tuple[int, int, str]] = []
    for start, end, kind, score in sorted((x for x in found if x[3] >= ACCEPT), key=lambda x: (-x[3], x[0] - x[1], rank[x[2]], x[0])):
        if all(end <= s or start >= e for s, e, _ in out):
            out.append((start, end, kind))
    return sorted(out)


def redacted(text: str, at: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for each span."""
    parts, last = [], 0
    for start, end, kind in at:
        parts += [text[last:start], f"<{kind.upper()}>"]
        last = end
    return "".join([*parts, text[last:]])


def scanned(df: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` columns, each field with placeholders, and for each field the array of kinds in it (``<field>_kinds``)."""
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, T.StringType()) for c in fields], *[T.StructField(f"{c}_kinds", T.ArrayType(T.StringType())) for c in fields]])
    names = [f.name for f in schema]
    n = len(keep)

    def run(batches):
        for b in batches:
            texts, kinds = [], []
            for i in range(len(fields)):
                t, k = [], []
                for x in b.column(n + i).to_pylist():
                    at = spans(x, fields[i] == "author") if x else []
                    t.append(redacted(x, at) if at else x)
                    k.append(sorted({kind for _, _, kind in at}))
                texts.append(pa.array(t, pa.string()))
                kinds.append(pa.array(k, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *texts, *kinds], names=names)

    return df.select(*keep, *fields).mapInArrow(run, schema)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scanned(table(spark, sf_dir, "raw_content"), ("content", "author"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_kinds").alias("kinds")) for f in ("content", "author")])
    return x.select("id", F.explode(each).alias("f")).select("id", "f.field", F.explode("f.kinds").alias("kind")).distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "raw_content"), ("content", "author")).select("id", "content", "author")
