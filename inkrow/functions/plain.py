"""The rules of functions.text on plain strings, for code that reads whole pages in Arrow batches; tests hold the two against each other.

Text is never None here. Results that a column holds as null are None.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from typing import NamedTuple

from inkrow.functions.jamo import FINALS, INITIALS, MEDIALS
from inkrow.functions.text import CENTURIES, CUT_ENDINGS, DASHES, DIGITS, ISSUER_ENDINGS, KIND_WORDS, LICENSE_TYPES, LOOKALIKES, MASKS, PROVINCE_STEMS, PROVINCES, REGIONS, SPECIAL_KINDS

#: White space as in functions.text, for use within brackets; where a Java pattern's dollar sign fits, and any character its dot fits.
SPACE = " \\t\\n\\x0b\\f\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
END, ANY = r"(?=(?:\r\n|(?<!\r)\n|[\r\x85\u2028\u2029])?\Z)", r"[^\n\r\x85\u2028\u2029]"
SPACES, HANGUL, NO_HANGUL = re.compile(f"[{SPACE}]+"), re.compile("[가-힣]"), re.compile("[^가-힣]+")
HANGUL_RUN, DIGIT_RUN, SIGN_RUN = re.compile("[가-힣]+"), re.compile("[0-9]+"), re.compile(f"[0-9{MASKS}]+")
_LIKE, _DASHED = str.maketrans(LOOKALIKES, DIGITS), str.maketrans(DASHES, "-" * len(DASHES))


_ODD_SPACES = re.compile(f"[{SPACE.replace(' ', '')}]|  ")


def collapse_spaces(text: str) -> str:
    return (SPACES.sub(" ", text) if _ODD_SPACES.search(text) else text).strip(" ")


def fix_digits(token: str) -> str:
    kinds = [unicodedata.category(c) for c in token]
    signs = sum(k[0] in "LN" for k in kinds)
    return token.translate(_LIKE) if signs and kinds.count("Nd") * 10 >= signs * 6 else token


_ANY_DASH, _ANY_LIKE = re.compile(f"[{DASHES}]"), re.compile(f"[{LOOKALIKES}]")


@lru_cache(1024)
def numeric_view(text: str) -> str:
    text = text.translate(_DASHED) if _ANY_DASH.search(text) else text
    spaced = collapse_spaces(HANGUL_RUN.sub(r" \g<0> ", text))
    return " ".join(map(fix_digits, spaced.split(" "))) if _ANY_LIKE.search(spaced) else spaced


def hangul_count(text: str) -> int:
    return len(NO_HANGUL.sub("", text))


_BEFORE_HANGUL, _NUMBERS = re.compile(f"[0-9][{SPACE}.]*[가-힣]"), re.compile(f"[0-9{SPACE}.]+")


def text_after_numbers(text: str) -> str:
    at = _BEFORE_HANGUL.search(text)
    return collapse_spaces(text[_NUMBERS.match(text, at.start()).end() :]) if at else ""


def _found(text: str, signs: re.Pattern, parse: Callable) -> list:
    """What parse(place, runs, gaps) gives for each run of the signs, None aside. Runs and gaps end with four of None."""
    runs, gaps = [*signs.findall(text), None, None, None, None], [*signs.split(text), None, None, None, None]
    return [x for i in range(len(runs) - 4) if (x := parse(i, runs, gaps)) is not None]


class Number(NamedTuple):
    """A registration number; back is None where any of its digits is hidden."""

    front: str
    sex: str
    back: str | None

    @property
    def formatted(self) -> str:
        return f"{self.front}-{self.sex}{self.back or '******'}"

    @property
    def birth(self) -> date | None:
        century = next((c for c, digits in CENTURIES.items() if self.sex in digits), "")
        return day(century + self.front[:2], self.front[2:4], self.front[4:])

    @property
    def checksum_ok(self) -> bool | None:
        digits = [int(c) for c in self.front + self.sex + self.back] if self.back else []
        return (11 - sum(d * (2 + i % 8) for i, d in enumerate(digits[:12])) % 11) % 10 == digits[12] if digits else None

    def valid(self, today: date | None) -> bool:
        birth = self.birth
        return self.sex not in "90" and birth is not None and today is not None and birth <= today and today.year - birth.year <= 120

    def derived(self) -> dict[str, str | None]:
        n = int(self.sex)
        return {"birth_date": self.birth and self.birth.isoformat(), "gender": "M" if n % 2 else "F", "is_foreigner": "true" if 5 <= n <= 8 else "false"}


@lru_cache(65_536)
def day(year: str, month: str, dom: str) -> date | None:
    try:
        return date(int(year), int(month), int(dom))
    except ValueError:
        return None


_MAY_BE_NUMBER = re.compile(f"[0-9{LOOKALIKES}]{{6}}")
_OPENS, _WHOLE = re.compile(rf"(?:^|[{MASKS}])[0-9]{{6}}\Z"), re.compile(rf"(?:^|[{MASKS}])[0-9]{{7}}[0-9{MASKS}]{{6}}\Z")
_DASHED_BACK, _PARTED_BACK, _SIX = re.compile(rf"[0-9](?:[0-9{MASKS}]{{6}}|[{MASKS}]{{0,5}})\Z"), re.compile(rf"[0-9][0-9{MASKS}]{{6}}\Z"), re.compile(r"[0-9]{6}\Z")


def _number(i: int, runs: list, gaps: list) -> Number | None:
    own, after, gap = runs[i], runs[i + 1], gaps[i + 1].strip(" ")
    if _WHOLE.search(own):
        n = own[-13:]
    elif after and _OPENS.search(own) and (gap == "-" and _DASHED_BACK.match(after) or gap == "" and _PARTED_BACK.match(after)):
        n = own[-6:] + after
    else:
        return None
    return Number(n[:6], n[6], n[7:13] if _SIX.match(n[7:13]) else None)


def find_rrns(text: str) -> list[Number]:
    return _found(numeric_view(text), SIGN_RUN, _number) if _MAY_BE_NUMBER.search(text) else []


_MAY_BE_DATE, _YEAR, _SIGN = re.compile(f"[0-9{LOOKALIKES}]{{4}}"), re.compile(r"(?:19|20)[0-9]{2}\Z"), re.compile(f"[{SPACE}]*[.,]")


class Dated(NamedTuple):
    """A date as it's written, and its day, None where there is no such day."""

    raw: str
    value: date | None

    @property
    def said(self) -> str:
        return self.value.isoformat() if self.value else self.raw


def _date(i: int, runs: list, gaps: list) -> Dated | None:
    year, month, dom = runs[i : i + 3]
    if month is None or dom is None or not _YEAR.match(year) or len(month) > 2 or len(dom) > 2:
        return None
    first, second, rest = gaps[i + 1 : i + 4]
    if first.strip(" ") not in (".", ",", "-", "/") or second != " " and second.strip(" ") not in (".", ",", "-", "/"):
        return None
    sign = _SIGN.match(rest)
    ends = "" if not sign or sign[0] == rest and runs[i + 3] is not None else sign[0]
    return Dated(f"{year}{first}{month}{second}{dom}{ends}", day(year, month, dom))


def find_dates(text: str) -> list[Dated]:
    return _found(numeric_view(text), DIGIT_RUN, _date) if _MAY_BE_DATE.search(text) else []


_NOT_LEADING = re.compile(f"(?s)[^가-힣{SPACE}].*")


def leading_hangul(text: str) -> str:
    return SPACES.sub("", _NOT_LEADING.sub("", text))


_NAME = re.compile(r"[가-힣]{2,5}\Z")


def name_is_valid(name: str) -> bool:
    return bool(_NAME.match(name))


_CLOSING, _OPENING = re.compile("[)）]"), re.compile("[(（]")
_CHINESE = re.compile(r"[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]")


def hanja_in_parens(text: str) -> str | None:
    for part in _CLOSING.split(text)[:-1]:
        opened = _OPENING.search(part)
        if opened and opened.end() < len(part):
            held = part[opened.end() :]
            return SPACES.sub("", held) if _CHINESE.search(held) and not HANGUL.search(held) else None
    return None


_PROVINCE, _STEM = re.compile("(" + "|".join(PROVINCES) + ")(?=[^ ])"), re.compile("|".join(PROVINCE_STEMS))


def space_after_province(text: str) -> str:
    own = _PROVINCE.match(text)
    return f"{own[1]} {text[own.end() :]}" if own else text


def address_is_valid(address: str) -> bool:
    return bool(_STEM.match(address)) and len(address) >= 8


_ENDINGS, _MEANT = tuple(ISSUER_ENDINGS), {e[0]: e for e in ("청장", "시장", "군수")}


def repair_issuer(text: str) -> tuple[str, bool]:
    *front, last = space_after_province(collapse_spaces(text)).split(" ")
    s = " ".join(front) + ("" if not front or last in ("장", "청장", "시장", "군수") else " ") + last
    if s.endswith(_ENDINGS):
        return s, False
    wrong = _MEANT.get(s[-2]) if len(s) >= 3 and HANGUL.match(s[-1]) else None
    if wrong:
        return s[:-2] + wrong, True
    cut = next(((a, b) for a, b in CUT_ENDINGS if s.endswith(a)), None)
    return (s[: -len(cut[0])] + cut[1], True) if cut else (s, False)


_ISSUER = re.compile("(?:" + "|".join(ISSUER_ENDINGS) + ")" + END)


def issuer_is_valid(issuer: str) -> bool:
    return len(issuer) >= 4 and bool(_ISSUER.search(issuer))


_PARTS = re.compile(r"[0-9]+(?:-[0-9]+)?|[가-힣]+|[()]|[^0-9가-힣()]+")
#: Where any part of an address may want a space before it: no rule of spaced fits elsewhere.
_TIGHT = re.compile(r"[로길동][0-9]|[가-힣][0-9]+차\)|[0-9가-힣]\(|\)[0-9가-힣]|[0-9](?:동[0-9]+호|차[0-9]+층)")


def fix_spacing(text: str) -> str:
    """address.fix_spacing."""
    if not _TIGHT.search(text):
        return collapse_spaces(text)
    parts = _PARTS.findall(text)
    padded, out = ["", "", *parts, None, None], []
    for i, own in enumerate(parts):
        earlier, before, _, after, later = padded[i : i + 5]
        number, plain, said = own[0] in "0123456789", own.isdecimal() and own.isascii(), bool(HANGUL.match(own))
        word, is_number = bool(HANGUL.match(before)), before[-1:] in tuple("0123456789")
        street = number and before.endswith(("로", "길")) and (after is None or after.startswith(" ") or after == "(")
        unit = plain and earlier[-1:] in tuple("0123456789") and after is not None and (before == "동" and after.startswith("호") or before == "차" and after.startswith("층"))
        block = plain and word and after == "차" and later == ")"
        quarter = number and before.endswith("동") and len(before) >= 2
        bracket = own == "(" and (word or is_number) or before == ")" and (number or said)
        out.append(" " + own if street or unit or block or quarter or bracket else own)
    return collapse_spaces("".join(out))


_MAY_BE_LICENSE = re.compile(f"[0-9{LOOKALIKES}{MASKS}]{{6}}")
_CODES, _NAMES = {v: k for k, v in REGIONS.items()}, sorted(REGIONS.values(), key=len, reverse=True)
_REGION, _TWO, _CHECK, _NO_DIGIT = re.compile(rf"(?:^|[{MASKS}])[0-9]{{2}}\Z"), re.compile(r"[0-9]{2}\Z"), re.compile(r"..(?:[*●•]|\Z)"), re.compile("[^0-9]")


class License(NamedTuple):
    """A licence number; printed is the region's name in its old form."""

    region: str
    year: str
    serial: str
    check: str
    printed: str | None

    @property
    def formatted(self) -> str:
        return "-".join([self.region, self.year, _NO_DIGIT.sub("X", self.serial), _NO_DIGIT.sub("X", self.check)])

    @property
    def masked(self) -> bool:
        return bool(_NO_DIGIT.search(self.serial + self.check))

    @property
    def valid(self) -> bool:
        return self.region in REGIONS


def _dash(gap: str | None) -> bool:
    return gap is not None and gap.strip(" ") == "-"


def _old_license(i: int, runs: list, gaps: list) -> License | None:
    year, serial, check = runs[i : i + 3]
    if check is None or (len(year), len(serial), len(check)) != (2, 6, 2) or not (_dash(gaps[i + 1]) and _dash(gaps[i + 2])):
        return None
    name = next((n for n in _NAMES if gaps[i].rstrip(" ").endswith(n)), None)
    return name and License(_CODES[name], year, serial, check, name)


def _new_license(i: int, runs: list, gaps: list) -> License | None:
    region, year, serial, check = runs[i : i + 4]
    if check is None or not all(map(_dash, gaps[i + 1 : i + 4])) or not (_REGION.search(region) and _TWO.match(year) and len(serial) == 6 and _CHECK.match(check)):
        return None
    return License(region[-2:], year, serial, check[:2], None)


def find_license_numbers(text: str) -> list[License]:
    if not _MAY_BE_LICENSE.search(text):
        return []
    return _found(text, DIGIT_RUN, _old_license) or _found(numeric_view(text), SIGN_RUN, _new_license)


def jamo(text: str) -> str:
    out = []
    for c in text:
        n = ord(c) - 0xAC00
        out.append(INITIALS[n // 588] + MEDIALS[n % 588 // 28] + FINALS[n % 28].strip(" ") if 0 <= n <= 11171 else c)
    return "".join(out)


def near(a: str, b: str) -> bool:
    """Whether one letter put in, left out or replaced at most makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


_KINDS = {k: jamo(k) for k in KIND_WORDS}


@lru_cache(65_536)
def _near_kind(word: str) -> str | None:
    if word in _KINDS:
        return word
    own = jamo(word)
    found = [k for k, letters in _KINDS.items() if len(k) == len(word) and near(letters, own)]
    return found[0] if len(found) == 1 else None


_UNITS = re.compile(rf"(?<!\d)[12][{SPACE}]*(?:종[{SPACE}]*(?=[가-힣]{{2}}))?(?=[가-힣]{{2}})|[가-힣]{{2,3}}(?:[{SPACE}]*[(（][^)）]*[)）])?")
_SUBS, _SUB_SIGNS, _ONES = re.compile(f"[(（]({ANY}*)[)）]"), re.compile(f"[,·.{SPACE}]+"), str.maketrans("lI", "11")


def find_license_types(text: str) -> list[str]:
    grade = following = None
    kinds: dict[str, None] = {}
    for unit in _UNITS.findall(text.translate(_ONES)):
        name = HANGUL_RUN.match(unit)
        if not name:
            following = unit[0]
            continue
        kind, left, following = _near_kind(name[0]), following, None
        own = {"특수": "1", "원동기": "2"}.get(kind)
        found = left or own or grade
        if kind and found:
            grade = found
            held = _SUBS.search(unit) if kind == "특수" else None
            subs = [s for s in dict.fromkeys(_SUB_SIGNS.split(held[1])) if s in SPECIAL_KINDS] if held else []
            kinds.update(dict.fromkeys([f"1종특수({s})" for s in subs] or ["1종특수"] if kind == "특수" else [f"{found}종{kind}"]))
    return list(kinds)


def license_type_is_valid(kind: str) -> bool:
    return kind.split("(")[0] in LICENSE_TYPES


_SERIAL = re.compile(r"[A-Z0-9]{6}\Z")
_SAME_SIGNS = {**dict.fromkeys("0OQ", "0OQ"), **dict.fromkeys("1I", "1I")}


def find_serial_code(text: str) -> str | None:
    bare = SPACES.sub("", text)
    return bare if _SERIAL.match(bare) else None


def has_lookalike(code: str) -> bool:
    return any(c in _SAME_SIGNS for c in code)


def serial_alternatives(code: str, most: int = 16) -> list[str]:
    grown, n = [""], 1
    for c in code:
        n *= len(_SAME_SIGNS.get(c, c))
    if n - 1 > most:
        return []
    for c in code:
        grown = [p + x for p in grown for x in _SAME_SIGNS.get(c, c)]
    return [g for g in grown if g != code]


_CODE_SIGNS = re.compile("[,· \\t\\n\\x0b\\f\\r]+")


def condition_codes(text: str) -> list[str] | None:
    rest = text.strip(" ")
    if not rest.startswith("조"):
        return None
    for signs in ("조", "건", ":：;"):
        rest = rest.lstrip(" ")
        rest = rest[1:].lstrip(" ") if rest[:1] and rest[0] in signs else rest
    return [s for s in _CODE_SIGNS.split(rest) if s] if 1 <= len(rest) <= 12 else None


def aptitude_kind(text: str) -> str | None:
    hangul = NO_HANGUL.sub("", text)
    return "APTITUDE" if "적성" in hangul else "RENEWAL" if "갱신" in hangul else None
