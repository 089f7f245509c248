"""Labelled training windows for the tagger: invented prose with personal data and credentials in many forms, and with
numbers, identifiers and phrases that only look like them."""

from __future__ import annotations

import string

import numpy as np

HEX, LOWER, UPPER = "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase
BASE62 = string.ascii_letters + string.digits
#: Syllables of the invented prose, words that announce a datum, and words of streets and months.
SYLLABLES = "an er th on in re la é ou st ä de ly ción ch a ti mo ß ung ment que eau os ñ heit keit ble ing the and of und der le la el ra ke lo su va do ni be go hi pu".split()
COMMON = "the of and to in is that it was for on with as be by this from are which at not have he she they we you water would other into more time when people there their some what about could these first made over after house world still found great".split()
ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kn kr l m n p pf ph pl pr qu r s sc sch sh sk sl sm sn sp st str sw t th tr tw v w wh wr x y z zw ç ñ ll rr nd nt tz ngth thwh".split()
VOWELS = "a e i o u y ä ö ü é è ê à á í ó ú ai au ea ee ei eu ie io oa oo ou ui eau ión".split()
CODAS = ["", "", "", *"n r s t l m d nd nt st ng ck ght x z wh w ft lk rm pf ux aux tz ch sh th".split()]
ANNOUNCE = "token key secret password passwd pwd api_key apikey api-key access_token auth_token client_secret API_KEY SECRET_KEY PASSWORD TOKEN secret_key access-key Passwort contraseña credential passphrase".split()
PLAIN_KEYS = "name title value color width path mode lang id type state label class author count level kind theme size user file host port page".split()
STREETS = "Street Road Avenue Lane Drive Court Way Square Street".split()
ROADS = ["rue de", "avenue de", "rue du", "calle", "calle de", "avenida", "Via", "boulevard"]
MONTHS = "January February March April May June July August September October November December".split()
LETTERS_OF_COUNTRIES = "DE FR ES GB NL IT BE AT CH PT".split()


class Maker:
    """Draws windows; every draw comes from one seeded generator."""

    def __init__(self, seed: int) -> None:
        self.g = np.random.default_rng(seed)
        self.syllables, self.most = SYLLABLES, 4

    def pick(self, xs):
        return xs[int(self.g.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.g.random() < p)

    def number(self, lo: int, hi: int) -> int:
        return int(self.g.integers(lo, hi + 1))

    def run(self, alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in self.g.integers(0, len(alphabet), n))

    def digits(self, n: int) -> str:
        return self.run("0123456789", n)

    def tongue(self) -> None:
        """Another invented language: the syllables of the words to come."""
        made = self.number(0, 5)
        self.most = self.number(2, 6)
        if made == 0:
            self.syllables = SYLLABLES
        elif made == 1:
            self.syllables, self.most = COMMON, 1
        else:
            new = [(self.pick(ONSETS) if self.chance(0.8) else "") + (self.pick(VOWELS) if self.chance(0.8) else "") + self.pick(CODAS) for _ in range(self.number(8, 45))]
            self.syllables = [x for x in new if x] + ([*SYLLABLES[:20]] if self.chance(0.3) else [])

    def stem(self, most: int = 0) -> str:
        return "".join(self.pick(self.syllables) for _ in range(self.number(1, most or self.most)))

    def plain(self, most: int = 3) -> str:
        return "".join(self.pick("aeionrstlmdcu") for _ in range(self.number(2, 3 * most)))

    def word(self, style: str) -> str:
        w = self.stem()
        if style == "upper":
            return w.upper() + self.pick(["", "!!", "!", ","])
        if style == "signs":
            return w + self.pick(["", "###", "%%%", "&&&", "***", "$$$", "!!", " |"])
        w = w.capitalize() if self.chance(0.12) else w.upper() if self.chance(0.02) else w
        return w + self.pick(["", "", "", "", "", "", ",", ".", ".", ";", ":", "?"] if self.chance(0.3) else [""])

    # credentials

    def hashed(self) -> str:
        return self.run(HEX if self.chance(0.85) else HEX.upper(), self.pick([32, 40, 40, 64]))

    def marked(self) -> str:
        """A credential that its own form gives away."""
        make = self.number(0, 7)
        if make == 0:
            return "ghp_" + self.run(BASE62, 36)
        if make == 1:
            return self.pick(["sk-", "sk_live_", "pk_test_", "rk_live_"]) + self.run(BASE62, self.number(24, 48))
        if make == 2:
            return self.pick(["AKIA", "ASIA"]) + self.run(UPPER + "234567", 16)
        if make == 3:
            return self.pick(["xoxb-", "xoxp-"]) + self.digits(self.number(10, 12)) + "-" + self.digits(12) + "-" + self.run(BASE62, 24)
        if make == 4:
            return "AIza" + self.run(BASE62 + "-_", 35)
        if make == 5:
            return "eyJ" + self.run(BASE62, self.number(12, 24)) + ".eyJ" + self.run(BASE62, self.number(16, 40)) + "." + self.run(BASE62 + "-_", self.number(16, 32))
        if make == 6:
            return "glpat-" + self.run(BASE62 + "-_", 20)
        return self.run(BASE62, self.number(28, 44))

    def credential(self) -> tuple[str, str, str]:
        """(before, value, after)."""
        r = self.g.random()
        if r < 0.25:
            return self.pick(["", "", "use ", "Bearer ", "Authorization: Bearer "]), self.marked(), ""
        value = self.hashed() if r < 0.55 else self.marked() if r < 0.65 else self.run(BASE62, self.number(16, 40)) if r < 0.73 else self.run(LOWER, self.number(16, 40)) if r < 0.79 else self.phrase()
        before = self.pick(ANNOUNCE) + self.pick([" = ", "=", ": ", " : ", ":", " = ", " := "])
        if " " in value or self.chance(0.5):
            quote = self.pick(["\"", "\"", "'"])
            return before + quote, value, quote
        return before, value, ""

    def phrase(self) -> str:
        if self.chance(0.4):
            return self.pick(["-", " ", "_", "."]).join(self.plain(2) for _ in range(self.number(3, 5)))
        return self.plain(3).capitalize() + self.pick("!@#$_-") + self.digits(self.number(1, 4)) + self.pick(["", "!", "x"])

    # personal data

    def personal(self) -> tuple[str, str, str]:
        make = self.number(0, 15)
        d = self.digits
        if make <= 2:
            return "", self.plain() + self.pick([".", "_", "-", "", "+"]) + self.pick(["", d(1), d(2), self.plain(2)]) + "@" + self.plain(2) + self.pick(["", d(1), "-" + self.plain(2)]) + self.pick([".com", ".org", ".example.com", ".co.uk", ".de", ".fr"]), ""
        if make == 3:
            at, dot = self.pick([(" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", ".")])
            return self.pick(["", "mail ", "write to "]), self.plain() + at + self.plain(2) + dot + self.pick(["com", "org", "de"]), ""
        if make == 4:
            return "", ".".join(str(self.number(0, 255)) for _ in range(4)), ""
        if make == 5:
            sep, n = self.pick(["", "", " ", "-"]), d(16)
            return self.pick(["", "card ", "Visa "]), sep.join(n[i : i + 4] for i in range(0, 16, 4)), ""
        if make <= 8:
            return self.pick(["", "", "tel. ", "call ", "phone: ", "Tel.: "]), self.pick([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(6)}", f"+{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}"]), ""
        if make == 9:
            return self.pick(["tel. ", "Tel.: ", "phone ", "Telefon "]), self.pick([f"0{d(2)}/{d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"6{d(2)} {d(3)} {d(3)}", f"0{d(3)} {d(6)}", f"0{d(4)}-{d(5)}"]), ""
        if make <= 11:
            tail = d(18)
            iban = self.pick(LETTERS_OF_COUNTRIES) + d(2)
            return self.pick(["", "IBAN ", "IBAN: ", "account "]), iban + (" " + " ".join(tail[i : i + 4] for i in range(0, 18, 4)) if self.chance(0.6) else tail), ""
        if make == 12:
            return self.pick(["", "SSN ", "SSN: "]), f"{d(3)}-{d(2)}-{d(4)}", ""
        if make == 13:
            day = self.pick([f"{self.number(1, 28)}/{self.number(1, 12)}/19{d(2)}", f"{self.number(1, 28)}.{self.number(1, 12)}.19{d(2)}", f"19{d(2)}-0{self.number(1, 9)}-{self.number(10, 28)}", f"{self.number(1, 28)} {self.pick(MONTHS)} 19{d(2)}"])
            return self.pick(["born on ", "born ", "date of birth: ", "DOB ", "DOB: ", "geboren am "]), day, ""
        number = str(self.number(1, 199))
        name = self.plain(2).capitalize()
        return self.pick(["", "at ", "lives at ", "address: "]), self.pick([f"{number} {name} {self.pick(STREETS)}", f"{name}straße {number}", f"{name}weg {number}", f"{number} {self.pick(ROADS)} {name}"]), ""

    # what only looks like either

    def harmless(self) -> str:
        d = self.digits
        make = self.number(0, 19)
        if make == 18:
            word = self.stem()
            return self.pick([" ", " ", ". ", ", ", "\n"]).join([word if self.chance(0.7) else word.capitalize()] * self.number(3, 30))
        if make == 19:
            return self.pick(["Licensed under the MIT License.", "Permission is hereby granted, free of charge,", "Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "GNU General Public License", "Creative Commons Attribution", "Terms of use apply.", "All rights reserved."])
        if make == 0:
            return d(self.number(1, 7))
        if make == 1:
            return self.pick(["version ", "v", "release "]) + f"{d(1)}.{d(1)}" + self.pick(["", f".{d(1)}", f".{d(2)}"])
        if make == 2:
            return f"CC BY-NC {d(1)}.0." if self.chance(0.5) else f"Copyright (c) 20{d(2)} The {self.plain().capitalize()} Authors. All rights reserved."
        if make == 3:
            return self.pick([f"19{d(2)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"{self.number(1, 28)} {self.pick(MONTHS)} 20{d(2)}", f"{self.number(1, 28)}/{self.number(1, 12)}/20{d(2)}"])
        if make == 4:
            return self.pick([f"1{d(1)}:{d(2)}", f"{d(2)}.{d(2)}", f"${d(3)}", f"{d(2)} %", f"{d(1)},{d(3)},{d(3)}", f"{d(3)} EUR", f"{d(1)}.{d(4)}e-{d(1)}"])
        if make == 5:
            return self.pick([f"#{d(4)}", f"order {d(6)}", f"No. {d(5)}", f"room {d(3)}", f"p. {d(2)}-{d(2)}", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"])
        if make == 6:
            return self.pick([f"@{self.plain()}", f"{self.plain()}{d(2)}", f"r/{self.plain()}", f"#{self.plain()}"])
        if make == 7:
            return f"| {d(3)} | {d(2)} |"
        if make == 8:
            return self.pick(PLAIN_KEYS) + self.pick([" = ", "=", ": "]) + self.pick([self.plain(), f"\"{self.plain()}\"", d(2), f"'{self.plain()} {self.plain()}'", "true"])
        if make == 9:
            return self.pick(["commit ", "sha1 ", "checksum ", "md5: ", "sha256: "]) + self.run(HEX, self.pick([7, 8, 12, 32, 40, 64]))
        if make == 10:
            return self.pick(["the password is", "password reset", "a secret garden", "the key to", "token economy", "forgot password?", "keys and values", "secret:", "the token was", "Passwort vergessen", "key word"]) + " " + self.stem()
        if make == 11:
            return "https://" + self.plain() + ".org/" + self.plain() + self.pick(["", "/" + self.plain(), ".html", f"?page={d(1)}"])
        if make == 12:
            return "".join(self.stem(2).capitalize() for _ in range(self.number(2, 5))) if self.chance(0.5) else "_".join(self.plain() for _ in range(self.number(2, 5)))
        if make == 13:
            return "".join(self.stem() for _ in range(self.number(2, 7)))
        if make == 14:
            return self.pick("=-*_#~.") * self.number(3, 40)
        if make == 15:
            return self.pick([f"<{self.plain(1)}>", f"</{self.plain(1)}>", f"{self.plain()}({self.plain()}, {d(1)})", f"[{d(1)}]", f"({d(4)})", f"x{d(1)} = {d(2)} + {d(1)}"])
        if make == 16:
            return f"{d(1)} {self.stem()} {d(2)} {self.stem()}"
        return f"{self.plain()} at {self.plain()}" if self.chance(0.5) else f"{self.number(1, 99)} {self.plain()} {self.plain()}"


def examples(n: int, seed: int, length: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n windows of at most length characters with their spans (start, end, kind), kind secret or other."""
    m = Maker(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        m.tongue()
        style, density = m.pick(["prose", "prose", "prose", "upper", "signs"]), m.pick([0.0, 0.0, 0.06, 0.14])
        while len(text) < length + 17:
            if m.chance(density):
                kind = m.pick(["secret", "other"])
                before, value, after = m.credential() if kind == "secret" else m.personal()
                text += before
                spans.append((len(text), len(text) + len(value), kind))
                text += value + after + (m.pick(["", "", "", ".", ",", "###", "%%%", "!!", ")", ";"]))
            else:
                text += m.harmless() if m.chance(0.12) else m.word(style)
            text += m.pick([" ", " ", " ", " ", " ", "\n"])
        text, r = text.rstrip(), m.g.random()  # windows begin as texts do, end as texts do, or neither
        shift = 0 if r < 0.3 else max(0, len(text) - length) if r < 0.7 else m.number(0, 15)
        cut = [(max(0, s - shift), min(e - shift, length), k) for s, e, k in spans if e - shift > 2 and s - shift < length - 2]
        out.append((text[shift : shift + length], cut))
    return out
