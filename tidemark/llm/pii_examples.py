"""The labelled table from which the tagger of personal information is trained.

It is made by rule: sentences with slots, filled with invented words and numbers; what goes into a slot
brings its label. Everything is drawn from a seeded generator, so the table is the same in every run.
"""

from __future__ import annotations

import random
import re

# Carrier sentences. {N} name, {E} email, {P} phone, {I} identity number, {A} street address.
CARRIERS = [
    "Spoke with {N} about it.", "{N} will present the results.", "thanks, {N}", "Author: {N}", "{N} disagreed with the estimate.", "Minutes were taken by {N}.", "the desk of {N} is empty",
    "It was {N} who found the gap.", "Gespräch mit {N} am Freitag.", "{N} übernimmt das Thema.", "Zuständig ist {N}.", "Vu avec {N} ce matin.", "{N} valide demain.", "Hablé con {N} ayer.", "{N} lo revisa mañana.",
    "from {N} to the whole group", "name on the badge: {N}", "We owe {N} an answer.", "as {N} put it, not now", "{N}, please confirm.", "forwarded by {N}: see below", "{N}: I can't reproduce it", "{N}'s laptop broke.",
    "({N})", "Kontakt {N}", "{O} {N} {w} {o} {w}", "{O} {N}, {o} {w} {w}.", "{O} {N}: {w} {w}", "{N} {w} {o} {w} {o} {w}.", "according to {N} this is fine", "{N} [maintainer]", "approved-by: {N}", "D'accord avec {N} là-dessus.", "The talk by {N} was cancelled in June.", "{N} and {N} share a room.", "Herrn {N} informieren",
    "Ring {P} in an emergency.", "phone {P}", "Phone: {P}", "mobile {P} or {P}", "Her extension is {P}.", "dial {P} and wait", "text {P} when done", "Telefon {P}", "Handy: {P}", "erreichbar unter {P}.", "fax {P}",
    "joignable au {P}", "tél : {P}", "teléfono {P}", "móvil {P}", "the hotline {P} is dead", "voicemail on {P}", "caller id showed {P}, nobody spoke", "{P} is out of service", "{P} (office)",
    "SSN {I}", "ID number {I}", "his tax id is {I}", "insurance record {I} is a duplicate", "passport no. {I}", "Passnummer {I}", "Ausweis {I} abgelaufen", "NIF: {I}", "DNI: {I}", "su DNI es {I}", "documento {I}", "numéro fiscal {I}", "carte d'identité {I}",
    "a row with {I} leaked", "{I} is masked now", "the scan shows {I}, cut it", "filed as {I}", "TIN {I}", "{I} (second column)", "Versicherung {I} fehlt", "identity card {I} expired.", "somebody typed {I} into the search box.",
    "lives at {A}", "Address: {A}", "Deliver to {A}.", "the parcel for {A} came back", "Adresse: {A}", "wohnhaft {A}", "liefern an {A}.", "habite {A}", "domicilio: {A}", "vive en {A}.", "meet us at {A} at noon",
    "the site at {A} has no power", "registered office {A}", "send letters to {A} only", "map pin: {A}", "{A} is the former address",
    "mail {E}", "write to {E} for access.", "From: {E}", "To: {E}", "{E} bounced", "my address is {E}, use that", "login {E}", "user {E} cannot sign in", "E-Mail an {E}", "bitte {E} informieren.", "courriel : {E}", "correo {E}",
    "invite {E} and {E}", "Manda todo a {E}.", "Envoie tout à {E} demain.", "hand it over to {E} when it works", "<{E}>", 'owner="{E}"', "email={E};", "subscribed: {E} / {E}",
    "{N} / {P}", "{E}", "{P}", "{A}", "{I}", "{N}",
]
# Sentences without personal information. {W} invented word, {F} file, {D} number, {w} common word.
PLAIN = [
    "{W} reads {F} twice and drops {D} {w}.", "Why is {W} slower than {W} on {D} {w}?", "I renamed {W} to {W} in {F}.", "{D} of {D} {w} passed, the {w} of {W} did not.", "In {F}, {W} calls {w} before {w}.", "The {w} {w} grew by {D} since {W}.",
    "Set {w} to {D}, then rerun {W}.", "see {F} line {D} for the {w}", "{W} failed after {D} s: {w} {w} {w}", "Let {W} wait for {W}; {D} {w} is too much.", "{W}, {W} and {W} use the same {w}.", "As of {W} the {w} has {D} {w}.",
    "Version {D1}.{D2}.{D1} of {W} needs {w}.", "{W}=={D1}.{D1}.{D2}", "upgrade {W}@{D1}.{D1}.{D1} first", "bind to 127.0.0.{D1}:{D4}", "peer 192.168.{D1}.{D2} timed out on port {D4}", "see issue {U}-{D4} and PR #{D3}", "{O} {U}-{D2}-{D4} stays open", "{W} {U}-{D3}", "{O} {w} {U}-{D2}-{D4}",
    "commit {H} reverts {H}", "sha {H16} differs", "id {H16}{H16} not found", "bytes {D10} to {D10} are missing", "seek({D10})", "epoch {D10} is wrong", "ids {D4}-{D4} are free", "rows {D3}-{D3}", "on 2025-{D2}-{D2} at {D2}:{D2}", "at {D2}:{D2}:{D2}.{D3} {W} stopped",
    "clone git@{w}.{w}:{w}/{w}.git", "push to git@{w}.{w}:{W}/{w}", "git@{w}-{w}.{w}:{w}/{w}", "origin git@{w}.{w}.{w}:{w}/{w}.git now", "@{w}.mark({D4})", "@{w} decorates {w}", "the {W} Road project", "theme {W} Street, dark", "{W} Lane beats {W} Hub", "{W} Avenue is a codename", "use {W} Kit", "{W} Court {w}", "{W} Way and {W} Drive are features.",
    "(tool-only turn: Read, Write) {F}", "(tool-only turn: {W}, {W}) {F}", "(tool-only turn: {W}) {F}", "({w}: {W}, {W}) {F}", "{F}: {w} {w}", "# {W} {W}", "## {w} {w}", "- {w}: {D}", "* {W} {w}", "TODO {w} {W}", "{W}: {w}", "{W}; {w}", "{w} / {w} / {w}", "{W} ({w})", "[{w}] {W} {w}", "{D} {w}, {D} {w}", "{D}", "{W}", "ok 👍", "[image]",
    "{W} hat {D} {w} verloren, weil {F} fehlt.", "Bitte {W} erst nach {D} {w} starten.", "Warum braucht {W} so lange?", "Die {w} in {F} passen nicht zu {W}.", "Der {W} ist {w}.", "Seit {W} sind {D} Zeilen {w}.", "Das {W} von {W} bleibt.",
    "{W} perd {D} lignes dans {F}.", "Pourquoi {W} dépend de {W} ?", "Le {W} de {F} est {w}.", "On a {w} {D} {w} hier.", "La {w} de {W} reste.", "{W} pierde {D} filas en {F}.", "¿Por qué {W} depende de {W}?", "El {W} de {F} está {w}.", "Hay {D} {w} en {W}.", "La {w} de {W} sigue.",
    "Assistant: {W} is {w}", "User: {w} {W}?", "Agreed.", "No.", "{W} Team {w}", "Monday {W} {w}", "In March {W} {w} {D} {w}.", "merge {w}/{w} into {W}", "Step {D1}: {w} {W}", "total: {D} {w}", "{w}={D} {w}={D}", "{w}_{w}({D}, {D})", "{W}::{W}", "{W}.{w}()", "/{w}/{w}/{D4}",
]
# Frequent words of the four languages that are in no name. {o} such a word, {O} with a capital.
CLOSED = (
    "a about after again all also an and any are as ask at be because before but by can check close could did do does each else every first fix for from give got had has have he her here his how i if in into is it its keep "
    "last let look make may move my new next no not now of on once one only open or our please put run said say see send set she should since so some still take tell than that the their then there these they this those "
    "to today tomorrow try under until use was we were what when where which while who why will with would yes yesterday you your "
    "aber alle auch auf aus bei bis bitte das dem den der die ein eine er es für gestern heute ich ihr im ist ja jetzt kein laut mit morgen nach nein nicht noch nur ob oder ohne seit sie sind so über und unter von vor wann warum was weil wenn wer wie wir wird wo zu zum zur "
    "après au aussi aux avant avec ce cette ces dans de demain depuis des du elle en est et hier il je la le les mais ne non nous on ou où oui par pas pour pourquoi quand que qui sans selon ses son sur un une voir "
    "bash edit read write al antes ayer como con cuando cuándo del desde después donde dónde el ella ellos es está hasta hay hoy las lo los mañana más muy no nos o para pero por porque qué quién se según si sí sin sobre su también te tu un una y ya"
).split()
# Titles, which are no part of a name.
TITLES = ["Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Frau", "Herr", "Mme", "Sr.", "Sra.", "Hr.", "Fr."]
BARE, BETWEEN = ["{N}", "{E}", "{P}", "{A}", "{I}"], [" / ", "; also ", " and ", "; ", ", "]
JOINS = [" ", " ", "\n", "\n\n", " / ", "; also ", " and ", " 🧭 ", " - "]
_ON, _MID, _END = "b br c cr d dr f fl fr g gl gr h j k kr l m n p pl pr qu r s sk st t th tr v w x z bl cl sm sp sh".split(), "a ae ei i ia o ou u e ea".split(), "b c d f g k l m n nd nk p r rk s sk st th x z l m n r".split()
_TOWN = ["stead", "wick", "ford", "holt", "mere", "ton", "bury", "dorf", "ville", "heim"]
_COMMON = "lane marker cache shard ledger index rows files pages records stream quote gate closed moved broad narrow warm cold keeps split merged trimmed counted pending parser schema seconds minutes bytes lines retries messages der gelöschte puffer zeiger verschoben gekürzt filtre rapport gardé vérifié coupé recibo vínculo firmado midió enlazó oculto grande the of hidden public oversized verified".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.given: set[str] = set()
        self.family: set[str] = set()

    def word(self, n: int | None = None) -> str:
        r = self.r
        return "".join(r.choice(_ON) + r.choice(_MID) + (r.choice(_END) if r.random() < 0.7 else "") for _ in range(n or r.choice((1, 2, 2, 3))))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def product(self) -> str:
        w = self.word(self.r.choice((2, 2, 3)))
        k = self.r.random()
        w = w.capitalize() if k < 0.55 else w
        if self.r.random() < 0.03:
            (self.given if self.r.random() < 0.5 else self.family).add(w.lower())
        return w + (self.r.choice(("Lane", "Kit", "Hub", "-core", "-ui", "-sync", "-feed", "_v2", "-db")) if self.r.random() < 0.3 else "")

    def name(self) -> str:
        r = self.r
        g, f = self.word(r.choice((1, 2, 2))).capitalize(), self.word(r.choice((1, 2, 2))).capitalize()
        if r.random() < 0.7:
            self.given.add(g.lower())
        if r.random() < 0.7:
            self.family.add(f.lower())
        if r.random() < 0.1:
            f += "-" + self.word(2).capitalize()
        k = r.random()
        out = f"{g} {f}" if k < 0.5 else f"{g[0]}. {f}" if k < 0.64 else f"{f}, {g}" if k < 0.78 else f"{f} {g[0]}." if k < 0.86 else f"{f}, {g[0]}." if k < 0.92 else f"{f} {g}" if k < 0.96 else f"{g} {self.word(1)[0].upper()}. {f}"
        return out.upper() if r.random() < 0.15 else out

    def email(self) -> str:
        r = self.r
        a, b = self.word(2), self.word(2)
        local = r.choice((f"{a}+{self.word(2)}", f"{a}.{b}", f"{a}{r.randint(1, 99)}", f"{a[0]}{b}", f"{a}-{b[0]}", f"{a}_{b}", a))
        w, tld = self.word, r.choice(("com", "org", "net", "io", "dev", "de", "fr", "es", "co.uk", "test", "invalid", "example", "example.com", "example.org"))
        host = r.choice((f"{w(2)}.{tld}", f"{w(1)}-{w(2)}.{tld}", f"{w(1)}.{w(2)}.{tld}", f"{w(1)}.{tld}"))
        k = r.random()
        if k < 0.25:
            at = r.choice((" at ", " (at) ", "[at]", " [at] ", "(at)", " AT "))
            dot = r.choice((" dot ", " (dot) ", "[dot]", " [dot] ", "(dot)")) if r.random() < 0.8 else "."
            return local.replace(".", dot if r.random() < 0.3 else ".") + at + host.replace(".", dot)
        out = f"{local}@{host}"
        return out.upper() if k < 0.35 else re.sub(r"\b[a-z]", lambda m: m[0].upper(), local) + "@" + host if k < 0.5 else out

    def phone(self) -> str:
        d = self.digits
        return self.r.choice((
            f"+44 20 {d(4)} {d(4)}", f"+49 30 {d(5)} {d(3)}", f"0049 (0)30 {d(8)}", f"030/{d(5)}-{d(3)}", f"({d(3)}) 555-{d(4)}", f"+1 ({d(3)}) 555-{d(4)}", f"+1{d(3)}555{d(4)}", f"+1{d(10)}",
            f"{d(3)}.555.{d(4)}", f"{d(3)}-555-{d(4)}", f"{d(3)} 555 {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1 {d(3)} 555 {d(4)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"0{d(2)} {d(7)}", f"+1-{d(3)}-555-{d(4)}",
        ))

    def identity(self) -> str:
        d, r = self.digits, self.r
        letter = r.choice("ABCDEFGHJKLMNPQRSTVWXYZ")
        return r.choice((
            f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"99{d(6)}{letter}", f"99{d(6)}-{letter}", f"99.{d(3)}.{d(3)}-{letter}", f"{d(8)}{letter}",
            f"{r.choice('XYZQ')}{letter}99{d(5)}", f"{letter}{r.choice('XK')}{d(7)}",
        ))

    def address(self) -> str:
        r, d = self.r, self.digits
        w, town, n = self.word(2).capitalize(), self.word(2).capitalize() + r.choice(_TOWN), str(r.randint(1, 240))
        sep = r.choice((", ", "\n", ", "))
        tail = r.choice((f"{town} {d(5)}", f"{town}, {d(5)}", f"{d(5)} {town}", town))
        apt = f" Apt {r.randint(1, 60)}" if r.random() < 0.4 else ""
        kind = r.choice(("Street", "Road", "Lane", "Way", "Drive", "Avenue", "Court", "Blvd"))
        return r.choice((
            f"{n} {w} {kind}{apt}{sep}{tail}", f"{n} {w} {kind}{apt}{sep}{tail}", f"{w}straße {n}{r.choice(('', 'a', 'b'))}{sep}{d(5)} {town}", f"{w} Str. {n}{r.choice(('', 'a'))}{sep}{tail}", f"{w}weg {n}, {d(5)} {town}",
            f"{n} {w} St.{sep}{tail}", f"{n} rue du {w}{sep}{d(5)} {town}", f"{n}, rue de {w}, {d(5)} {town}", f"calle {w} {n}, {r.randint(1, 9)}º {r.choice('ABCD')}{sep}{d(5)} {town}", f"calle {w} {n}, {d(5)} {town}", f"{n} {w} {kind}",
        ))

    def fill(self, template: str) -> list[tuple[str, str]]:
        """Parts (text, label) of a template; label O outside slots."""
        r, out = self.r, []
        for p in re.split(r"(\{\w+\})", template):
            k = p[1:-1] if p[:1] == "{" else ""
            if k == "N" and r.random() < 0.22:
                out.append((r.choice(TITLES) + " ", "O"))
            if k in ("N", "E", "P", "I", "A"):
                out.append(({"N": self.name, "E": self.email, "P": self.phone, "I": self.identity, "A": self.address}[k](), k))
                continue
            if k == "W":
                p = self.product()
            elif k == "w":
                p = r.choice(_COMMON) if r.random() < 0.6 else self.word()
            elif k in ("o", "O"):
                p = r.choice(CLOSED)
                p = p.capitalize() if k == "O" else p
            elif k == "F":
                p = f"{r.choice(('src', 'lib', 'docs', 'tests', 'jobs', 'web', 'app', 'tools'))}/{self.word(2)}{r.choice('/-_')}{self.word(2)}.{r.choice(('py', 'sql', 'ts', 'rs', 'md', 'css', 'toml', 'json'))}"
            elif k == "D":
                p = r.choice((self.digits(4), self.digits(3), self.digits(2), f"{self.digits(2)}.{self.digits(1)}", f"{self.digits(3)},{self.digits(3)}", f"{self.digits(2)},{self.digits(3)}"))
            elif k.startswith("D"):
                p = self.digits(int(k[1:]))
            elif k == "U":
                p = "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(r.choice((2, 3, 3, 4))))
            elif k.startswith("H"):
                p = "".join(r.choice("0123456789abcdef") for _ in range(int(k[1:] or 7)))
            out.append((p, "O"))
        return out


def salad(m: Maker) -> str:
    """A stretch of words, numbers and signs in no language, with or without an item in it: what stands around an item tells little."""
    r = m.r
    out = [r.choice(("{O}", "{O}", "{O},", "{W}", "{w}"))]
    for _ in range(r.choice((3, 5, 8, 12))):
        out.append(r.choice(("{w}", "{w}", "{o}", "{o}", "{o}", "{w}", "{W}", "{D}", "{F}", "{w},", "{w}:", "({w})", "{W}.", "{w}; {O}", "{D4}", "{D1}", "{H}", "{D4}-{D2}-{D4}", "{D2}-{D4}", "{D4}/{D3}", "{D4}.{D2}.{D2}", "{D1}.{D2}.{D1}", "{D10}", "{w}. {O}", "@{w}.{w}({D4})", "@{w}.{w}({w})", "@{w}", "{W}@{D1}.{D2}.{D1}", "{O} {W}@{D1}.{D1}.{D1}", "{U}-{D2}-{D4}", "{U}-{D4}", "{W}. D'{w}", "l'{w}", "C'est {w}", "— {O} {D4}{H} {w}")))
    if r.random() < 0.5:
        item = r.choice((*BARE, "{E}", "{P}", "{P} {w}", "{w} {P}", "{o} {E}", "{E} {O}", "{I} {w}", "{w} {I}", "{w}. {N} {w}", "{w}={E}", "{w}-{w}={E}", '{w}: "{E}"', "<{E}>", "{w}-{w}: {P}", "{w}={I}"))
        out.insert(r.randint(0, len(out)), item + r.choice(("", "", ".", ",", ":", "?")))
    return " ".join(out)


def table(n: int = 4000, seed: int = 11) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], set[str], set[str]]:
    """(text, spans (start, end, label)) examples, and the given and family names of the example roster."""
    m = Maker(seed)
    out = []
    for k in range(n):
        text, spans = "", []
        sentences = []
        for _ in range(m.r.choice((1, 2, 3))):
            x = m.r.random()
            sentences.append(salad(m) if x < 0.3 else m.r.choice(CARRIERS) if x < 0.6 else m.r.choice(PLAIN))
        if sentences[-1].endswith("}") and m.r.random() < 0.7:  # what follows a name without a full stop
            sentences.append(m.r.choice(PLAIN))
        if k % 4 == 0:  # every template comes up
            sentences.append((CARRIERS + PLAIN)[k // 4 % (len(CARRIERS) + len(PLAIN))])
        for s in sentences:
            if text:
                text += m.r.choice(JOINS)
            if m.r.random() < 0.12:  # one item after another, as in lists of contacts
                s = s.rstrip() + m.r.choice(BETWEEN) + m.r.choice(BARE)
            for part, label in m.fill(s):
                if label != "O":
                    spans.append((len(text), len(text) + len(part), label))
                text += part
        out.append((text, spans))
    return out, m.given, m.family


def lexicon() -> set[str]:
    """Lower-case words of the templates themselves: the only words known by name, none of them a slot's."""
    known = set(_COMMON) | set(CLOSED) | {t.rstrip(".").lower() for t in TITLES} | {"str", "st", "street", "road", "lane", "way", "drive", "avenue", "court", "blvd", "apt", "rue", "calle", "du", "de", "at", "dot", "git"}
    for t in CARRIERS + PLAIN + JOINS:
        known |= {w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(r"\{\w+\}", " ", t))}
    return known - set("invalid test example mail com org net io dev de fr es co uk".split())  # what hosts consist of
