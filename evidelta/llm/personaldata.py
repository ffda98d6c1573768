"""Invented sentences with known mentions of personal data, to train the model of ``personal`` on.

Every name, number and address is made up from random syllables and digits. A part of the given names is unknown to the
list below, so that the model learns the words around a name as well as the list.
"""

from __future__ import annotations

import random

# Common given names of four languages. Names that are also everyday words are left out.
GIVEN = frozenset(
    """
    aaron adam albert alexander alfred alice amy andrew anna anthony arthur benjamin beth     charles clara colin daniel david dora edward edwin     elizabeth emily emma eric esther felix george hannah helen henry
    howard hugh isaac jacob james janet jennifer john jonathan joseph julia
    karen kevin laura linda louis lucy margaret maria martha martin mary matthew
    michael michelle nadia nancy nathan nicholas nora oliver olivia paul peter philip rachel rebecca
    richard robert roger ruth samuel sandra sarah sharon simon sophia stephen susan teresa thomas timothy victor
    vincent walter wanda william
    amélie antoine bastien benoît camille céline chloé françois gaspard hélène inès jacques julien luc mathieu noémie
    pierre rémi sylvie thibault théo yves zoé
    anke björn dieter friedrich grete günter heike helga jürgen käthe klaus lothar maren matthias petra renate sabine
    stefan uwe     alejandro andrés carmen diego íñigo inés javier joaquín josé lucía marisol miguel pablo pilar rafael raúl rocío tomás
    """.split()
)

# What introduces a person.
CUES = (
    "Deponent Witness affiant, /s/ Dr. Mr. Mrs. Ms. Prof. From: Contact Contact: asked Name: attorney client patient employee Notice~to: In~re name~is "
    "Frau Herr Zeuge Zeugin Klägerin an: Rückfragen~an soussigné soussignée témoin Pour Contact~: Mme Mlle Monsieur Madame Contacto: testigo testiga Doña Don Sr. Sra. D.ª D./D.ª D."
).replace("~", "\u00a0").split(" ")
CUES = tuple(c.replace("\u00a0", " ") for c in CUES)

_ONSET = "b br c cr d dr f fl fr g gr h j k kr l m n p pr qu r s sk st t th tr v w x y z".split()
_VOWEL = "a e i o u ae ai ea ie oo ou".split()
_CODA = "b ck d l ll ld lt m n nd nk r rd rk rn s sk st t th v x z".split()
_END = "son er man ley ton well by field ard ish ova ell ane ow ume en ar ick ery ade ine ent orn ull ax".split()
_PLACES = "Parish County Island Harbor Basin Valley Strait Delta Ridge Moor Bay Springs Heights Park Province Lake".split()
_THINGS = "easement ledger mortgage lien permit harvest ferry boundary tenancy wharf license contract invoice report estate auction".split()
_MONTHS = "January February March April May June July August September October November December".split()
_STREET = "Street St. Avenue Ave Road Rd. Lane Drive Court Blvd. Terrace Place Way Square".split()
_HOSTS = "example.com example.org example.net mail.example post.test lex.invalid web.test office.example chambers.example.net sub.mail.example.org firma.test".split()
_NICK = "Skip Bee Tully Red Buddy Mac Junior Ace Kit Dot".split()


class _Maker:
    """One random sentence after another."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def stem(self) -> str:
        r = self.r
        out = r.choice(_ONSET) + r.choice(_VOWEL) + (r.choice(_CODA) if r.random() < 0.7 else "")
        return (out + (r.choice(_ONSET) + r.choice(_VOWEL) if r.random() < 0.2 else "") + (r.choice(_END) if r.random() < 0.8 else "")).capitalize()

    def digits(self, n: int) -> str:
        return "".join(str(self.r.randrange(10)) for _ in range(n))

    def shaped(self, shape: str) -> str:
        return "".join(str(self.r.randrange(10)) if c == "9" else self.r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") if c == "X" else c for c in shape)

    def family(self) -> str:
        r = self.r
        out = self.stem()
        if r.random() < 0.06:
            out = r.choice(["Mac", "Mc", "O'", "D'"]) + out
        if r.random() < 0.1:
            out += "-" + self.stem()
        return out

    def person(self) -> str:
        r = self.r
        given = r.choice(_GIVEN) if r.random() < 0.92 else self.stem()
        family = self.family()
        if r.random() < 0.04:
            family = r.choice(["von ", "van ", "de "]) + family
        if r.random() < 0.12:
            family += " " + self.family()
        x = r.random()
        if x < 0.17:
            out = f"{family}, {given}"
        else:
            middle = f" {r.choice('ABCDEFGHJKLMNPRSTW')}." if x < 0.33 else f" “{r.choice(_NICK)}”" if x < 0.39 else " " if x < 0.45 else ""
            out = f"{given}{middle} {family}"
        return out.upper() if r.random() < 0.1 else out

    def email(self) -> str:
        r = self.r
        first, last = r.choice(_GIVEN).lower(), self.stem().lower()
        first = first.encode("ascii", "ignore").decode() or "ann"
        local = r.choice([f"{first}.{last}", f"{last}_{self.digits(2)}", f"{first[0]}{last}", f"{last}.{first}{self.digits(r.randrange(1, 3))}", f"{first}+{r.choice(['filings', 'news', 'office', 'case'])}", f"{last}", f"{first}-{last}", f"{first}{self.digits(4)}"])
        at = r.choice(["@"] * 8 + [" @ ", " [at] ", " (at) ", " AT ", " at ", "[at]", "(at)"])
        host = r.choice(_HOSTS)
        if at != "@" and r.random() < 0.5:
            host = host.replace(".", r.choice([" [dot] ", " (dot) ", "[dot]", " dot "]))
        if at == " at " and "." in host:
            at = " AT "
        out = local + at + host
        return out.upper() if r.random() < 0.12 and "dot" not in host else out

    def phone(self) -> str:
        shape = self.r.choice(
            "(999) 999-9999|999-999-9999|999.999.9999|999 999 9999|9999999999|+1 999 999 9999|+1 (999) 999-9999|+1 (999) 999‑9999|1-999-999-9999|+44 99 9999 9999|099 9999 9999|+44 (0)99 9999 9999|09999 999999|"
            "09 99 99 99 99|09.99.99.99.99|+33 9 99 99 99 99|+33 (0)9 99 99 99 99|0999999999|+49 (0)99 / 99999999|099 99999 999|+49 99 99999999|+49 999 9999999|099/9999999|"
            "999 999 999|999 99 99 99|+34 999 99 99 99|(+34) 999-99-99-99|+34 999 999 999|999.999.999|999-9999|+41 99 999 99 99".split("|")
        )
        return self.shaped(shape)

    def number(self) -> tuple[str, str]:
        """Label and number of a document of identity."""
        shape, labels = self.r.choice(
            [
                ("999-99-9999", "SSN |SSN: |Social Security No. |social security number |soc. sec. # ||"),
                ("999 99 9999", "SSN |Social Security number |soc. sec. # |"),
                ("999.99.9999", "SSN: |soc. sec. # |Social Security No. "),
                ("999999999", "SSN |SSN: |Social Security No. |social security number is |soc. sec. # |taxpayer no. "),
                ("99-9999999", "EIN |tax ID |taxpayer identification number "),
                ("X9999999", "passport no. |Passport: |passport number |Reisepass |passeport n° |pasaporte "),
                ("999999999", "passport no. |Passport: "),
                ("X999-9999-9999", "national ID |licence no. |driver's license |driving licence "),
                ("X9999999", "license no. |driver's license |licence no. "),
                ("9 99 99 99 999 999 99", "numéro INSEE |NIR |n° de sécurité sociale : "),
                ("999999999999999", "numéro INSEE |NIR |n° de sécurité sociale : "),
                ("99999999X", "DNI |NIF: |documento de identidad n.º |"),
                ("99.999.999-X", "DNI |NIF: |documento de identidad n.º "),
                ("99999999-X", "DNI |NIF "),
                ("X9999999X", "NIE |NIE: "),
                ("99 999 999 999", "Steuer-ID |IdNr. |Steueridentifikationsnummer: "),
                ("99999999999", "Steuer-ID |IdNr. |Steueridentifikationsnummer: "),
                ("X99999999", "Personalausweis |Ausweisnummer "),
            ]
        )
        return self.r.choice(labels.split("|")), self.shaped(shape)

    def address(self) -> str:
        r, n, z = self.r, self.r.randrange, self.digits(5)
        kind = r.random()
        if kind < 0.55:
            out = f"{n(1, 9999)} {r.choice(['', '', 'N. ', 'West ', 'South ', 'E. '])}{self.stem()} {r.choice(_STREET)}"
            out += r.choice(["", "", f", Apt. {n(1, 60)}", f", Suite {n(100, 400)}", f" #{n(1, 40)}", f", Unit {n(1, 20)}"])
            return out + r.choice(["", "", f", {self.stem()}", f", {self.stem()}, {r.choice(['QX', 'ZZ', 'NY', 'TX', 'XW'])} {z}", f" in {self.stem()}", f"\n{self.stem()}, {r.choice(['CA', 'QX'])} {z}"])
        tail = r.choice([f", {z} {self.stem()}", f", {z} {self.stem()}", ""])
        if kind < 0.7:
            return r.choice([f"{n(1, 200)} rue {self.stem()}", f"{n(1, 200)}, rue de {self.stem()}", f"{n(1, 200)} boulevard {self.stem()}", f"{n(1, 90)} bis avenue de {self.stem()}", f"{n(1, 90)} place {self.stem()}"]) + (tail or f"\n{z} {self.stem()}")
        if kind < 0.85:
            return r.choice([f"Calle {self.stem()} {n(1, 200)}", f"Calle {self.stem()} {n(1, 200)}, 3.º B", f"C/ {self.stem()} nº {n(1, 200)}", f"Avda. de {self.stem()}, {n(1, 200)}", f"Plaza {self.stem()}, {n(1, 40)}", f"Paseo de {self.stem()} {n(1, 40)}"]) + tail
        return r.choice([f"{self.stem()}straße {n(1, 200)}", f"{self.stem()}weg {n(1, 200)}{r.choice(['', 'a', 'b'])}", f"Am {self.stem()}-Platz {n(1, 200)}", f"{self.stem()}gasse {n(1, 90)}", f"{self.stem()}allee {n(1, 90)}"]) + tail

    def sentence(self) -> list[tuple[str, str | None]]:
        """Pieces of text, each with its kind or None."""
        r, t = self.r, self.r.choice(_THINGS)
        person = lambda: (self.person(), "person_name")
        address = lambda: (self.address(), "street_address")
        phone = lambda: (self.phone(), "phone")
        email = lambda: (self.email(), "email")

        def number() -> list:
            label, value = self.number()
            return [(label, None), (value, "id_number")]

        if r.random() < 0.62:
            made = r.choice(
                [
                    lambda: [("Deponent ", None), person(), (" lives at ", None), address(), (", and gave ", None), *number(), (".", None)],
                    lambda: [("My name is ", None), person(), (" and I live at ", None), address(), (".", None)],
                    lambda: [("Witness ", None), person(), (f" testified that the {t} was sold.", None)],
                    lambda: [(r.choice(["Dr. ", "Mr. ", "Ms. ", "Prof. "]), None), person(), (r.choice([" (call ", " (tel. "]), None), phone(), (f") objects to the {t}.", None)],
                    lambda: [("From: ", None), person(), (" <", None), email(), (f">\nRe: the {t}", None)],
                    lambda: [("Contact ", None), person(), (" at ", None), email(), (" or ", None), phone(), (".", None)],
                    lambda: [("Notice to: ", None), person(), ("; ", None), email(), ("; ", None), phone()],
                    lambda: [person(), (f" signed the {t} in {r.choice(['ink', 'blue ink', 'person'])}.", None)],
                    lambda: [("Counsel asked ", None), person(), (f" about the {t}.", None)],
                    lambda: [("Title went from ", None), person(), (" to the estate, then to ", None), address(), (".", None)],
                    lambda: [("(", None), person(), (f", aged {r.randrange(20, 90)}, gave no {t}.)", None)],
                    lambda: [("In re ", None), person(), (f": the {t} passed by will.", None)],
                    lambda: [("/s/ ", None), person(), ("\n", None), address(), ("\nTel. ", None), phone()],
                    lambda: [("Ring ", None), phone(), (" or write to ", None), email(), (".", None)],
                    lambda: [("Please reach me on ", None), phone(), ("; I am at work after noon.", None)],
                    lambda: [("Reply-to ", None), email(), ("; fax ", None), phone(), ("; post ", None), address(), (".", None)],
                    lambda: [("Send copies to ", None), address(), (".", None)],
                    lambda: [("Kindly strike ", None), *number(), (" from page two.", None)],
                    lambda: [("The form lists ", None), *number(), (".", None)],
                    lambda: [("The affiant, ", None), person(), (", ", None), *number(), (", appeared in person.", None)],
                    lambda: [("cc: ", None), email(), (", ", None), email()],
                    lambda: [("Service was made by e-mail on ", None), email(), (".", None)],
                    lambda: [("Je soussigné ", None), person(), (", demeurant ", None), address(), (", certifie les faits.", None)],
                    lambda: [("Pour ", None), person(), (", ", None), *number(), (", domicile élu : ", None), address(), (".", None)],
                    lambda: [("Le témoin ", None), person(), (" a été entendu.", None)],
                    lambda: [("Contact : ", None), person(), (", ", None), email(), (", ", None), phone(), (".", None)],
                    lambda: [("Tél. ", None), phone(), (" ; courriel ", None), email()],
                    lambda: [("La pièce mentionne ", None), *number(), (".", None)],
                    lambda: [("El testigo ", None), person(), (", con domicilio en ", None), address(), (", compareció.", None)],
                    lambda: [("D./D.ª ", None), person(), (", ", None), *number(), (", firmó el acta.", None)],
                    lambda: [("Contacto: ", None), person(), (", ", None), email(), (", tel. ", None), phone(), (".", None)],
                    lambda: [("Escriba a ", None), email(), (" o llame al ", None), phone(), (".", None)],
                    lambda: [("Notifíquese en ", None), address(), (".", None)],
                    lambda: [("Consta ", None), *number(), (".", None)],
                    lambda: [("Der Zeuge ", None), person(), (", wohnhaft ", None), address(), (", wurde gehört.", None)],
                    lambda: [("Frau/Herr ", None), person(), (" gab ", None), *number(), (" an.", None)],
                    lambda: [("Zustellung an: ", None), person(), ("\n", None), address()],
                    lambda: [("Rückfragen an ", None), person(), (", ", None), email(), (", Tel. ", None), phone(), (".", None)],
                    lambda: [("E-Mail ", None), email(), (" oder Telefon ", None), phone(), (".", None)],
                    lambda: [("Im Formular steht ", None), *number(), (".", None)],
                    lambda: [("The letter from ", None), person(), (f" reached the clerk; {t} unpaid.", None)],
                    lambda: [person(), (" moved to ", None), address(), (" in May.", None)],
                ]
            )()
            return made
        s, d, g = self.stem, self.digits, lambda: r.choice(_GIVEN)
        n = r.randrange
        year = n(1880, 2025)
        case = f"{s()} v. {r.choice([s(), s(), 'Port of ' + s(), g(), 'Port of ' + g()])}{r.choice(['', ' Freight Co.', ' Co.', ' Inc.'])}"
        text = r.choice(
            [
                lambda: f"{case}, {n(1, 999)} {s()[:5]}. {r.choice(['', '2d ', '3d ', 'Ct. App. '])}{n(1, 1500)} ({r.choice(['Sup.', 'App.', 'Civ.', 'Land'])} Ct. {s()} {year}).",
                lambda: case.upper() + f"\n{r.choice(['Land', 'Civ.', 'Mar.'])} Ct. {s()}\nNo. {d(2)}-{d(5)}\nDecided {n(1, 28)} {r.choice(_MONTHS)} {year}",
                lambda: case.upper() + f"\nNo. {d(2)}-CV-{d(4)}\nDecided {d(2)}-{d(2)}-{year}",
                lambda: f"Justice {s()} would have renewed the {t}.",
                lambda: f"{s()}, J., dissenting in part, calls the {t} void.",
                lambda: f"Saint {g()} Parish and {g()} County filed no {t}.",
                lambda: f"The case of {g()} {r.choice(_PLACES)} against {s()} {r.choice(_PLACES)} concerns the {t}.",
                lambda: f"Court Street precedents do not reach the {t}.",
                lambda: f"Serial SN {d(3)}-{d(4)}-{d(2)} appears twice.",
                lambda: f"Lot {d(4)} {d(4)} {d(4)} {d(1)} was pledged.",
                lambda: f"Bates range {d(6)}-{d(6)} was served at {s()} {r.choice(_PLACES)}.",
                lambda: f"The clerk filed Exhibit {d(2)}-{d(2)}-{d(3)} on {d(2)}-{d(2)}-{year}.",
                lambda: f"Docket {n(1, 9)}:{d(2)}-cv-{d(5)} and Exhibit {d(3)}-{d(2)}-B were sealed.",
                lambda: f"Case No. {d(3)}-{year}-{d(4)} cites {d(3)} {s()[:4]}. {d(3)}.",
                lambda: f"Host {n(1, 255)}.{n(1, 255)}.{n(1, 255)}.{n(1, 255)} logged the {t} at {d(2)}:{d(2)}:{d(2)}.",
                lambda: f"Over 1 {d(3)} pages ({d(3)} to {d(4)}) are sealed.",
                lambda: f"The ratio was {n(1, 9)} @ {n(1, 9)} per cent, rev. v{n(1, 9)}@draft.",
                lambda: f"The clerk wrote @{s()} in the margin.",
                lambda: "Write to [EMAIL] or call [PHONE].",
                lambda: f"The sum in dispute, ${d(3)},{d(3)}.{d(2)}, covers a {t}.",
                lambda: f"{s()} {r.choice(_PLACES)} bought the {t} in {year} and {s()} sold {n(1, 999)} acres.",
                lambda: f"Order {d(8)} and tracking number {d(4)} {d(4)} {d(4)} were noted.",
                lambda: f"Invoice no. {d(7)} of {d(2)}.{d(2)}.{year} is unpaid.",
                lambda: f"Under the {s()} {r.choice(_PLACES)} {r.choice(['Act', 'Code', 'Rule'])} of {year} the {t} is sealed; {s()} {r.choice(_PLACES)} agrees.",
                lambda: f"En el asunto {case} se discutió una tasa. El tribunal de {s()} {r.choice(_PLACES)} declaró la mora en {year}.",
                lambda: f"La cour rappelle l'arrêt {case}. Le tribunal de {s()} {r.choice(_PLACES)} a réduit la dette en {year}.",
                lambda: f"Im Fall {case} war zu entscheiden. Das Gericht in {s()} {r.choice(_PLACES)} hat {year} entschieden.",
                lambda: f"WHEN {s().upper()} LOST THE {t.upper()} THE {r.choice(['CLERK', 'OWNER'])} OF {s().upper()} GAVE A {t.upper()} TO {s().upper()}.",
                lambda: f"In {case} counsel asked about the {t}; from {s()} to {s()} it ran {n(1, 99)} miles.",
                lambda: f"Hon. Registrar {s()} is from {s()} {r.choice(_PLACES)}.",
                lambda: f"The fence at {n(1, 99)} Court Street exhibits and the {n(2, 9)} Road cases differ from {s()}, {g()} County.",
                lambda: f"Dr. {s()} told Mr. {s()} of the {t}.",
                lambda: f"Version {n(1, 9)}.{n(1, 9)}.{d(4)}.{d(3)} and sum {d(9)} were rejected as part {d(4)}-{d(4)}.",
            ]
        )()
        return [(text, None)]

    def row(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A few sentences, sometimes wrapped at a space or numbered."""
        r = self.r
        text, truth = "", []
        joint = r.choice([" ", "\n", "\n\n", " \r\n"])
        for k in range(r.randrange(1, 4)):
            if text:
                text += joint
            if joint == "\n" and r.random() < 0.5:
                text += f"{k + 1}. "
            for piece, kind in self.sentence():
                if r.random() < 0.15 and " " in piece:
                    at = r.choice([i for i, c in enumerate(piece) if c == " "])
                    piece = piece[:at] + "\n" + piece[at + 1 :]
                if kind:
                    truth.append((len(text), len(text) + len(piece), kind))
                text += piece
        return text, truth


_GIVEN = sorted(w.capitalize() for w in GIVEN)


def invented(n: int, seed: int = 20) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts with the start, end and kind of each mention."""
    maker = _Maker(seed)
    return [maker.row() for _ in range(n)]
