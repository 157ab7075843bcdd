"""Distances of Hangul words by their letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Initial, medial and final letters in the order of the syllable block; a blank stands for no final.
INITIALS, MEDIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


def jamo(text: Column) -> Column:
    """Every syllable as its two or three letters; other characters as they are."""

    def letters(c: Column) -> Column:
        n = F.ascii(c) - 0xAC00
        pick = lambda table, i: F.lit(table).substr((i + 1).cast("int"), F.lit(1))
        whole = F.concat(pick(INITIALS, F.floor(n / 588)), pick(MEDIALS, F.floor(n % 588 / 28)), F.trim(pick(FINALS, n % 28)))
        return F.when(n.between(0, 11171), whole).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), letters), "")


def jamo_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(jamo(a), jamo(b))
