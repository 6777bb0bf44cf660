"""The small labelled table the personal-information tagger is trained from: sentences whose pieces carry their type.

The rows are drawn from frames with a fixed seed, so the table needs no file. None of the frames is taken from a corpus the tagger
is used on; names, streets and towns are made of random syllables of several scripts, so a tagger trained on them has to go by shape
and surroundings. Every frame has a fold, and whole folds can be held out.
"""

from __future__ import annotations

import random
import re

# Common given names.
GIVEN = """Anna Bernard Clara David Emma Frank Greta Hannah Igor Julia Karl Laura Martin Nina Oscar Paula Robert Sofia Thomas Ursula Viktor Walter Yvonne
Zoe José Inés Jürgen Renée Łukasz André Tomás Chloé Björn Sébastien Álvaro Kate Ben Jo Liz Tom Ed Sam Max Mia Lu Fritz James Mary John Patricia Michael Linda William Elizabeth
Richard Susan Joseph Jessica Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Sandra Steven Ashley Paul Kimberly Andrew Emily Joshua Donna Kevin Michelle Brian
George Carol Edward Amanda Ronald Melissa Timothy Deborah Jason Stephanie Ryan Rebecca Jacob Sharon Gary Cynthia Nicholas Eric Amy Jonathan Peter Hans Klaus Sabine Monika Pierre
Marie Jean Luc Claire Antoine Carlos Miguel Ángel Carmen Lucía Javier Pilar Jiří Pavel Seán Niamh Ludwig Maria Olga Ivan Анна Иван Ольга Сергей""".split()
# Street words of several languages.
STREET_EN = "Street St Road Rd Lane Ln Ave. Avenue Court Drive Way Close Terrace Crescent Boulevard".split()
STREET_DE = "straße str. weg allee gasse platz ring damm".split()
STREET_FR = "rue avenue allée place chemin boulevard impasse quai".split()
STREET_ES = ["Calle", "Avenida", "C/", "Plaza", "Paseo", "Camino"]
NOUNS = """account anchor answer audit backup badge balance board bucket budget build cache calendar catalog center chain channel chart cloud cluster code column commit
console contract copy core counter cursor daemon data deck default disk domain edge error event export feature field file floor folder forecast format frame
gateway graph group guard handle harbor hash header heap host image index input invoice issue layer ledger library limit line list log machine map meeting
memory merge model module monitor network node note office order owner page panel parser patch path pipeline plan platform plugin policy pool port process
product profile project proxy queue record registry release report request review ring role root route router row rule sample scan schema screen script search
section segment server service session shard shell site snapshot stage status store summary switch system table tag target task team tenant term test thread
ticket token tool trace unit update user value vault vector version view watcher window worker""".split()
VERBS = "accepts blocks breaks builds checks clears closes copies counts delays drops fails fetches fills finds holds joins keeps leaves loads locks loses makes marks merges misses moves opens parses prints pulls pushes reads renames repeats resets returns rewrites runs saves sends shows skips sorts splits starts stops stores takes trims turns waits writes".split()
ADJ = "late early slow fast broken empty dirty clean fresh lost blue green heavy light noisy quiet partial random shared stray tiny wide narrow lazy stale unused wrong extra local remote hidden read-only long-lived well-known half-done open public private national annual internal".split()
PAST = "saw found wrote said told noticed reported fixed opened closed signed sent asked joined left missed took gave read made cut kept held lost met moved owned checked changed pushed merged flagged raised".split()
SMALL = "as in for of with near before after at on by until from to and or but so while since under over behind beside inside because".split()
FOREIGN = "Contacter Appeler Voir Demander Prévenir Joindre Signalé Envoyé Avisar Llamar Escribir Preguntar Hablar Informado Ver Bitte Kontakt Gemeldet Anruf Fragen Siehe Laut Merci Gracias Danke Vu Visto Según Selon".split()
GERMAN = "im am und oder aber wurde wird steht geht liegt fehlt kommt an aus bei mit nach von zu Protokoll Eintrag Bericht Klartext Fehler Lager Antrag Schrank Zettel Ordner Aktenzeichen Anfang Ende Namen Händen Auftrag Raum".split()
FRENCH = "en au aux et ou mais avec pour dans chez sur sous est reste part va affiche journal dossier courrier clair bureau relevé rapport page fin début carton envoi clé pièce".split()
SPANISH = "en al y o pero con para por sobre bajo está queda sale va muestra registro archivo informe oficina fin principio caja envío llave pieza aviso falta claro lista nota".split()
OPENERS = """Ask Call Tell Ping Contact Email Write Dear Hello Hi Thanks Meet Remind Invite Notify Attention Signed Regards From Via See Per With For By To After Before When While Since Because Although Yesterday Today
Tomorrow Later Then Finally Also Maybe Please Only Even Both Either Our My His Her Their This That These The A An One Two Every Some Most Any No All Each If As At On In During Without Under Over Between Among Behind
Check Use Move Merge Add Remove Keep Open Close Read Run Send Set Put Let Make Take Give Find Show Try Wait Stop Start Review Approved Reviewed Reported According Onboarding Support Deliver Ship""".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def one(self, xs):
        return xs[int(self.r.random() * len(xs))]

    def num(self, n: int) -> str:
        return "".join(self.one("0123456789") for _ in range(n))

    def syllables(self, n: int, script: str = "latin") -> str:
        if script == "cyrillic":
            return "".join(self.one("бвгдзклмнпрст") + self.one("аеиоуяю") + self.one(["", "", "н", "р", "в"]) for _ in range(n))
        if script == "east":
            return "".join(self.one("bcčdďfhjklmnňprřsštvzžłşğ") + self.one("aáeéěiíoóuůúyöüăąę") + self.one(["", "", "k", "n", "r", "ň", "š"]) for _ in range(n))
        return "".join(self.one("bcdfghjklmnprstvwxyz") + self.one("aeiouaeiouäéúoó") + self.one(["", "", "l", "n", "r", "s", "ck", "m", "t", "p"]) for _ in range(n))

    def script(self) -> str:
        return self.one(["latin"] * 8 + ["east", "cyrillic"])

    def noun(self) -> str:
        return self.one(NOUNS)

    def family(self, script: str = "latin") -> str:
        f = self.syllables(self.r.randint(1, 3), script).capitalize()
        if script == "latin":
            f += self.one(["", "", "man", "dahl", "ski", "ini", "ade", "ström", "ley", "ez", "eau", "wick", "son", "berg", "thur", "quist"])
        x = self.r.random()
        if x < 0.16:
            return f"{f}-{self.syllables(self.r.randint(2, 3), script).capitalize()}"
        if x < 0.19:
            return self.one(["O'", "O’", "D'", "Mc", "Mac", "De", "Di"]) + f
        return f

    def given(self, script: str = "latin") -> str:
        if script != "latin":
            return self.syllables(self.r.randint(1, 3), script).capitalize()
        return self.one(GIVEN) if self.r.random() < 0.55 else self.syllables(self.r.randint(1, 4)).capitalize()

    def name(self) -> str:
        s = self.script()
        g, f, x = self.given(s), self.family(s), self.r.random()
        middle = self.one("ABCDEFGHIJKLMNOPRSTVW")
        if x < 0.33:
            return f"{g} {f}"
        if x < 0.47:
            return f"{f}, {g}"
        if x < 0.59:
            return f"{g[0]}. {f}"
        if x < 0.70:
            return f"{g} {middle}. {f}"
        if x < 0.79:
            return f"{g} {f}".upper()
        if x < 0.87:
            return f"{g} {self.one(['de', 'van', 'von', 'van der', 'de la', 'del', 'di', 'al', 'zu', 'ter'])} {f}"
        if x < 0.90:
            return f"{g} {self.given(s)} {f}"
        if x < 0.92:
            return f"{g} {self.given(s)} {f} {self.family(s)}"
        if x < 0.94:
            return f"{f}{self.one([',', ''])} {g[0]}."
        if x < 0.975:
            return f"{self.one(GIVEN).lower()} {f.lower()}"
        if x < 0.985:
            return f"{g[0]}.{self.one([' ', ''])}{middle}. {f}"
        return f"{g} “{self.one(GIVEN)}” {f}"

    def host(self) -> str:
        w = self.syllables(2).translate(str.maketrans("äéúó", "aeuo"))
        return self.one([f"{self.one(['mail', 'users', 'dev', 'post', w])}.{self.one(['example', w])}.{self.one(['com', 'org', 'net', 'eu', 'co.uk', 'com.au'])}", f"{w}.test", f"corp.{w}", "example.net", f"{self.noun()}.example", f"{w}.{self.one(['com', 'org', 'de', 'io', 'fr', 'es'])}"])

    def email(self) -> str:
        user = self.one([f"{self.syllables(2)}.{self.syllables(3)}", f"{self.one('abcdefgh')}{self.syllables(3)}", f"{self.one('abcdefgh')}-{self.syllables(3)}", f"{self.syllables(2)}_{self.syllables(3)}{self.num(2)}", f"{self.syllables(3)}+{self.noun()}", f"{self.syllables(2)}{self.num(2)}", f"{self.syllables(2)}.{self.syllables(2)}+{self.noun()}"])
        user, host = user.translate(str.maketrans("äéúó", "aeuo")), self.host()
        x = self.r.random()
        if x < 0.56:
            out = f"{user}@{host}"
        elif x < 0.68:
            out = f"{user} [at] {host}"
        elif x < 0.78:
            out = f"{user}(at){host}"
        elif x < 0.81:
            out = f"{user} (at) {host}"
        elif x < 0.97:
            out = f"{user} at {' dot '.join(host.split('.'))}"
        else:
            out = f"{user} AT {' DOT '.join(host.split('.'))}"
        return out.upper() if self.r.random() < 0.1 and x < 0.56 else out

    def phone(self, lang: str = "en") -> str:
        n = self.num
        a, b = str(self.r.randint(201, 989)), self.one(["555", n(3)])
        if lang == "de":
            return self.one([f"0049/{n(2)}/{n(8)}", f"0{n(2)} {n(8)}", f"(0{n(2)}) {n(5)}-{n(3)}", f"+49 {n(2)} {n(5)} {n(3)}", f"+49 {n(3)} {n(7)}", f"0{n(3)}/{n(6)}", f"+49-{n(3)}-{n(7)}"])
        if lang == "fr":
            return self.one([f"+33 {self.one('123456')} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{self.one('123456')} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{self.one('123456')}.{n(2)}.{n(2)}.{n(2)}.{n(2)}", f"+33(0){n(9)}", f"0033 {n(1)} {n(8)}"])
        if lang == "es":
            return self.one([f"+34 6{n(2)} {n(3)} {n(3)}", f"6{n(2)}-{n(3)}-{n(3)}", f"6{n(2)} {n(2)} {n(2)} {n(2)}", f"9{n(2)} {n(3)} {n(3)}", f"+34 6{n(8)}", f"6{n(2)} {n(3)} {n(3)}"])
        if lang == "xx":
            return self.one([f"+48 {n(3)} {n(3)} {n(3)}", f"+420 {n(3)} {n(3)} {n(3)}", f"+39 0{n(1)} {n(4)} {n(4)}", f"+31 6 {n(8)}", f"+7 {n(3)} {n(3)}-{n(2)}-{n(2)}"])
        p = self.one([f"+1-{a}-{b}-{n(4)}", f"+1 {a} {b} {n(4)}", f"+1 ({a}) {b}-{n(4)}", f"({a}) {b}-{n(4)}", f"{a}-{b}-{n(4)}", f"{a}.{b}.{n(4)}", f"07{n(3)} {n(3)} {n(3)}", f"07{n(3)} {n(6)}", f"+44 7{n(3)} {n(6)}", f"+44 7{n(3)} {n(3)} {n(3)}", f"020 {n(4)} {n(4)}"])
        return f"{p} {self.one(['ext. ', 'ext. ', 'x', 'extension '])}{n(self.r.randint(2, 4))}" if self.r.random() < 0.18 else p

    def identity(self, lang: str = "en") -> str:
        n, up = self.num, "ABCDEGHJKLMPQRSTWXYZ"
        u = lambda: self.one(up)
        if lang == "de":
            return self.one([n(11), f"{n(2)} {n(3)} {n(3)} {n(3)}", f"{u()}{n(2)}{u()}{u()}{n(4)}"])
        if lang == "fr":
            return self.one([f"{self.one('12')}{n(14)}", f"{self.one('12')} {n(2)} {n(2)} {n(2)} {n(3)} {n(3)} {n(2)}"])
        if lang == "es":
            return self.one([f"{n(8)}{u()}", f"{n(8)}-{u()}", f"{n(2)}.{n(3)}.{n(3)}-{u()}", f"{self.one('XYZ')}{n(7)}{u()}"])
        return self.one([f"{n(3)}-{n(2)}-{n(4)}", f"{n(3)} {n(2)} {n(4)}", f"{n(3)}-{n(2)}-{n(4)}", n(9), f"{u()}{n(2)}{u()}{n(5)}", f"{u()}{u()} {n(2)} {n(2)} {n(2)} {u()}", f"{u()}{u()}{n(6)}{u()}", f"{u()}{n(8)}", f"{u()}{u()}{n(7)}", f"{u()}{u()}-{n(4)}-{n(1)}"])

    def town(self) -> str:
        t = self.syllables(self.r.randint(2, 3)).capitalize()
        two = f"{self.one(['Port', 'San', 'Bad', 'East', 'Puerto', 'Mount', 'New', 'Lake', 'Fort', 'Upper'])} {t}"
        return self.one([t, t, t, two, two, f"{t} {self.one(['Bay', 'Hill', 'Falls', 'Springs'])}", f"Saint-{t}", f"{t}-sur-{self.syllables(1).capitalize()}"])

    def address(self, lang: str = "en") -> str:
        n, r = str(self.r.randint(1, 9900)), self.r
        cap = lambda k: self.syllables(k).capitalize()
        if lang == "de":
            return f"{cap(3)}{self.one(STREET_DE)} {r.randint(1, 180)}{self.one(['', '', 'a', 'b', 'c'])}, {self.num(5)} {self.one([cap(2), cap(3), self.town()])}"
        if lang == "fr":
            return f"{r.randint(1, 140)} {self.one(['', '', 'bis ', 'ter '])}{self.one(STREET_FR)} {self.one(['du', 'des', 'de la', 'de'])} {self.one(['', 'Vieux ', 'Trois ', 'Grand '])}{self.one([cap(2), cap(3)])}, {self.num(5)} {self.town()}"
        if lang == "es":
            return f"{self.one(STREET_ES)} {self.one(['del ', 'de la ', 'de los ', ''])}{self.one([cap(2), cap(3)])} {r.randint(1, 99)}, {self.one(['', f'{r.randint(1, 9)}º {self.one("ABCD")}, '])}{self.num(5)} {self.town()}"
        if lang == "xx":
            return self.one([f"Via {cap(3)} {r.randint(1, 99)}, {self.num(5)} {self.town()}", f"ul. {cap(3)} {r.randint(1, 99)}, {self.num(2)}-{self.num(3)} {cap(3)}", f"{cap(3)}gracht {r.randint(1, 300)}, {self.num(4)} {self.one('ABCD')}{self.one('EFGH')} {cap(2)}"])
        s = f"{self.syllables(r.randint(2, 4)).capitalize()} {self.one(STREET_EN)}"
        s = f"{self.one(['North', 'South', 'West', 'Old', cap(2)])} {s}" if r.random() < 0.1 else s
        n += self.one(["", "", "", "", "", "", "", "A", "B"])
        code = self.one([self.num(5)] * 4 + [f"{self.one('ABCDEFGHLMNPRSTW')}{self.one('BEGLNRSW')}{r.randint(1, 19)} {r.randint(1, 9)}{self.one('ABDEFGHJ')}{self.one('ABDEFGHJ')}"])
        town = self.town()
        end = self.one(["", f", {town}", f", {town} {code}", f", {town} {code}", f", {town}, {self.one(['IL', 'TX', 'CA', 'NY', 'MA'])} {self.num(5)}"])
        x = r.random()
        if x < 0.42:
            return f"{n} {s}{end}"
        if x < 0.72:
            return f"{n} {s}, {self.one(['Apt', 'Apt', 'Apt', 'Unit', 'Suite', 'Floor'])} {r.randint(1, 90)}{end}"
        return f"{self.one(['Flat', 'Flat', 'Flat', 'Unit', 'Apartment'])} {r.randint(1, 90)}, {r.randint(1, 400)} {s}{end}"

    # pieces of ordinary text

    def path(self) -> str:
        return f"{self.noun()}/{self.noun()}/{self.noun()}_{self.noun()}.{self.one(['py', 'ts', 'go', 'rs', 'java', 'md', 'yaml', 'rb', 'tsx', 'bzl'])}"

    def call(self) -> str:
        return f"{self.noun()}_{self.noun()}_{self.noun()}()"

    def camel(self) -> str:
        return "".join(self.noun().capitalize() for _ in range(self.r.randint(2, 3)))

    def hex(self, n: int = 9) -> str:
        return "".join(self.one("0123456789abcdef") for _ in range(n)) if self.r.random() < 0.96 else self.num(n)

    def title(self) -> str:
        return " ".join(self.noun().capitalize() for _ in range(self.one([1, 2, 2, 2, 3])))

    def acronym(self) -> str:
        return "".join(self.one("ABCDEFGHIKLMNOPRSTUX") for _ in range(self.r.randint(2, 5)))

    def version(self) -> str:
        return f"{self.num(1)}.{self.num(self.r.randint(1, 2))}.{self.num(self.r.randint(1, 2))}"

    def date(self) -> str:
        y, m, d = 1990 + self.r.randint(0, 45), self.r.randint(1, 12), self.r.randint(1, 28)
        return self.one([f"{y}-{m:02d}-{d:02d}", f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m:02d}/{d:02d}/{y}", f"{y}-{m:02d}-{d:02d}T{self.r.randint(0, 23):02d}:{self.num(2)}:{self.num(2)}Z"])

    def count(self) -> str:
        return self.num(self.r.randint(1, 7)).lstrip("0") or "7"


# {n}ame {e}mail {p}hone {i}dentity number {a}ddress; {O}pener, {w} noun, {v}erb, past {V}erb, {j} adjective, {f} small word, {d}, {r}, {s} German,
# French and Spanish words, {L} an opener in these; everything else is ordinary text.
WITH = {
    "en": [
        "{O} {n} whether the lease renews in spring.",
        "{O} {n} first, then write to {e} about the invoice.",
        "Parcel goes to {a}; the recipient is {n}.",
        "Please drop the spare keys at {a}, to the care of {n}.",
        "guests.csv: {n};{e};{p};{a}",
        "New hire list, line 4: {n};{e};{p};{a}",
        "{n},{e},{p}",
        "| {n} | {e} | {p} |",
        "name={n} mail={e} tel={p} addr={a}",
        "If we believe {n}, the door sensor at {a} has been dead for weeks.",
        "As {n} told me, the lift at {a} is stuck again.",
        "I walked through it with {n} over lunch and mailed the minutes to {e}.",
        "{n} found this one; reach out through {e} or {p}.",
        "{n} raised the alarm and answers at {e} or {p}",
        "Do not ring {p} after six, the desk is empty.",
        "Just dial {p} when the alarm goes off.",
        '{"customer_ssn": "{i}", "mobile": "{p}"}',
        'A debug line shows "national_id":"{i}","phone":"{p}" unmasked.',
        "Row nine of the seed file holds {i}, a real taxpayer number.",
        "Test data must not carry {i} as anybody's tax number.",
        "A caller read out the card: identity number {i}, home address {a}.",
        "The helpdesk copied in a client file with identity number {i}, address {a}.",
        "Tested-by: {n} <{e}>",
        "Acked-by: {n} <{e}>",
        "Co-developed-by: {n} <{e}>",
        "From: {n} <{e}>",
        "To: {e}, {e}",
        "bcc {e}, {e} and {e}",
        "{O} {n} ({e}) once the outage is over.",
        "Her passport number is {i}, her mobile {p}.",
        "Passport {i} and social security number {i} were both in the scan.",
        "My SSN is {i} and I live at {a}.",
        "The form lists NINO {i} next to {n}.",
        "Send the crate to {n}, {a}, or phone {p}.",
        "{n} of {a} opened the complaint.",
        "We met {n} and {n} on Friday and agreed on the price.",
        "The invoice carries the signatures of {n} and {n}.",
        "I heard from {n} last night.",
        "This chapter was translated by {n}.",
        "Dr. {n} will see you now.",
        "Mr {n} and Mrs {n} moved to {a}",
        "Interview with {n}, author of the guide",
        "{n}, {n} and {n} voted against it.",
        "Best regards, {n}",
        "Thanks to {n} for the careful review!",
        "Home: {a}",
        "Shipping address: {a}",
        "We are now at {a}.",
        "Office phone {p}, fax {p}.",
        "tel: {p}",
        "call me on {p} or mail {e}",
        "Owner {n}, deputy {n}, escalation {e}.",
        "Backup for the night shift is {n}, who reads {e}.",
        "The pager belongs to {n} ({p}).",
        "@todo {n}: remove the shim",
        "# maintainer {n} {e}",
        "Reported from {a} by {n}, tax id {i}.",
        "Employee {n} was born abroad; identity card {i}.",
        "His driver file shows {i} and {a}.",
        "assignee {n}; reviewer {n}",
        "The lease of {a} ends in May, see {e}.",
        "License request by {n}: {e}",
        "{n} {V} it and {w} {v} {f} {e} {f} {p}.",
        "{n} {V} the {j} {w} {f} {e}.",
        "{n} {V} {f} the {w}",
        "{O} {w} {v} {i} {f} the {j} {w}.",
        "The {j} {w} {f} {w} {v} {i} {f} {w}.",
        "{O} {w} {p} {f} {w}, the {w} is {j}.",
        "{O} {w} {f} {w} {v} {a} {f} {w}.",
        "{O} {f} {n}, the {w} {w} {f} {a} is {j}.",
        "{O} {w} {f} {a}, {w} {n}.",
        "{O} {w} {w}: {w} {w} {i}, {w} {a}.",
        "{O} {n} {f} the {w}, {w} {w} {f} {e}.",
        "{O} {n} {f} {w}; {w} {w} is {e}.",
        '{O} {w} has "{w}": "{i}", "{w}": "{p}" {f} {j} {w}.',
        "{w};{n};{e};{p};{a}",
        "{O} {w} {w}: {n};{e};{p};{a}",
        "{O} {n} {f} {w}.",
        "{O} {n}!",
        "The {w} {f} {a} is {j}.",
        "The {w} {f} {a} was {j} {f} {w}.",
        "{a} {v} the {j} {w}.",
        "{a} has a {j} {w}, {a} has none.",
        "{n};{e};{p};{a}",
        "{e} or {e}",
        "{n} / {n} / {n}",
        "{O} {w} {w} {w} {n}.",
        "{O} {w} {w} {w} {e}",
        "{O} {w} {w} {w} {p}",
        "{O} {w} {w} {w} {a}",
        "{O} {w} {w} {w} {i} {w} {w}",
    ],
    "de": [
        "Bei Fragen hilft {n} gern, Telefon {p}, Mail {e}.",
        "Auskunft gibt {n}, Telefon {p}, sonst {e}.",
        "Das Paket soll nach {a}, Empfänger ist {n}.",
        "Der Schlüssel geht an {a}, abzugeben bei {n}.",
        "Auf dem Beleg steht die Steuernummer {i} von {n}.",
        "Die Steuernummer {i} darf nicht in die Datei.",
        "Entdeckt hat es {n} ({e}).",
        "Laut {n} ist die Tür in {a} offen.",
        "{n} erreicht man unter {p}.",
        "Wir wohnen jetzt in {a}.",
        "Frau {n} und Herr {n} haben zugestimmt.",
        "Ausweis {i}, Inhaber {n}.",
        "Der {d} {d} {n} {d} {d}.",
        "Im {d} {d} die {d} {i} {d} {n} {d} {d}.",
        "Das {d} {d} {d} {a}, {d} {d} {n}.",
        "Sendung zu Händen von {n}, {a}.",
        "{d} {d} {d} {n}, {d} {p}, {d} {d} {e}.",
        "{L} {d} {n}, {d} {d} {p}.",
        "{L} {n} {d} {d}.",
    ],
    "fr": [
        "Joindre {n} au {p} ou bien écrire à {e}.",
        "Prévenir {n} au {p} ou par message à {e}.",
        "Déposer le colis au {a}, pour le compte de {n}.",
        "La livraison part au {a}, à remettre à {n}.",
        "On lit le numéro de sécurité sociale {i} sur la capture.",
        "Son numéro de sécurité sociale est {i}.",
        "Vu par {n} ({e}).",
        "D'après {n}, la porte du {a} reste ouverte.",
        "Merci à {n} et {n} pour la relecture.",
        "Nous habitons au {a}.",
        "Le {r} {r} {n} {r} {p} {r} {r} {e}.",
        "Le {r} {r} {r} {i} {r} {r}.",
        "Le {r} {r} {r} {a}, {r} {r} {n}.",
        "{L} {n} {r} {p} {r} {r}.",
        "{L} {r} {n} {r} {r}.",
    ],
    "es": [
        "Hablar con {n} en el {p} o mandar un correo a {e}.",
        "Pregunta por {n} en el {p} o escribe a {e}.",
        "El paquete va a {a}, lo recibe {n}.",
        "Dejar las llaves en {a}, a nombre de {n}. Nada más.",
        "En la captura se ve el documento {i} entero.",
        "Su documento de identidad es {i}.",
        "Lo encontró {n} ({e}).",
        "Según {n}, la puerta de {a} no cierra.",
        "Gracias a {n} y {n} por la revisión.",
        "Vivimos en {a}.",
        "El {s} {s} {n} {s} {p} {s} {s} {e}.",
        "El {s} {s} {s} {i} {s} {s}.",
        "La {s} {s} {s} {a}, {s} {s} {n}. {s} {s}.",
        "{L} {s} {n} {s} {p} {s} {s}.",
        "{L} {n}, {s} {p}.",
    ],
    "xx": ["{n} mieszka na {a}.", "Volejte {n}, {p}.", "Rivolgersi a {n}, {a}, tel. {p}.", "Bel {n} op {p} of mail {e}.", "Написал {n}, телефон {p}, почта {e}.", "Autor: {n} <{e}>", "Podepsán {n}.", "Отвечает {n}."],
}


def plain(m: Maker, fold: int | None = None, folds: int = 1, held: bool = False) -> str:
    n, c, w, r = m.num, m.camel, m.noun, m.r
    adj, verb = lambda: m.one(ADJ), lambda: m.one(VERBS)
    opener = lambda: m.one(OPENERS)
    frames = [
        lambda: f"{m.title()} and {m.title()} Road are project names here, running {n(2)} hosts on 10.{n(2)}.{n(3)}.{n(1)}.",
        lambda: f"Street {w().capitalize()} and {m.syllables(3).capitalize()} {m.one(STREET_EN)} name the {w()} racks, {n(2)} of them near 192.168.{n(1)}.{n(2)}.",
        lambda: f"Pulled {w()}@sha256:{m.hex(20)} with {m.count()} bytes, layer 20{n(2)}.{n(2)}.{n(6)}.",
        lambda: f"git clone git@code.example.org:{w()}/{w()}.git && git checkout {m.hex()}",
        lambda: f"Remote is ssh://git@forge.example.net/{w()}/{w()}.git at {m.hex(7)}",
        lambda: f"root@{w()}-{n(2)}: the {adj()} {w()} {verb()} its {w()}.",
        lambda: f"Annotate it with @{w()}_{w()} or @{w().capitalize()} and mention @{w()}-{w()} below.",
        lambda: f"npm install @{w()}/{w()}@{m.version()} --save-dev",
        lambda: f"ts=1{n(9)} run={n(6)}-{n(2)} tz=+0{n(1)}00 zone={m.version()} {w()}={m.count()}",
        lambda: f"The timestamp 1{n(9)} marks run {n(6)}-{n(1)}, shifted by +0{n(1)}00 hours.",
        lambda: f"Slots {n(2)}-{n(2)}-{n(2)} of {m.path()} are counters for the {w()}, up to {n(6)}.",
        lambda: f"At {m.date()} the {adj()} {c()} grew by {n(2)}.{n(1)}% and {m.call()} was to blame ({m.hex()}).",
        lambda: f"{opener()} release {m.version()} of {w()} {verb()} {m.call()}, so {c()} wants {m.version()} at least.",
        lambda: f"{opener()} {adj()} {w()} left {m.call()}: two writers met on it, see #{n(5)} or commit {m.hex()}.",
        lambda: f"{opener()} {adj()} {w()} {verb()} one {w()} with {n(2)} {w()} marks during a leap year.",
        lambda: f"{opener()} a trainee {verb()} the {adj()} {w()} beside {w().capitalize()} Row, then {n(2)} {w()} notes follow.".upper(),
        lambda: f"Der Aufruf {m.call()} trifft {m.count()} Rechner in {n(4)}ms, daher liegt {m.path()} nun in #{n(5)}.",
        lambda: f"Seit {m.date()} zeigt {c()} ganze {m.count()} Kanten doppelt, schuld war {m.call()} in {m.version()}.",
        lambda: f"Nur {c()} liest aus {m.path()} alle {n(2)} Spalten; bitte {m.call()} nicht anfassen.",
        lambda: f"Nach dem Umzug fiel die Zeit von {m.call()} auf {n(4)}ms, und {c()} steht bei {n(2)}.{n(1)}%.",
        lambda: f"Ne touchez pas à {m.path()}: {c()} en lit {n(2)} champs après {m.call()}.",
        lambda: f"Depuis {m.date()} on compte {m.count()} arêtes perdues dans {c()}, faute de {m.call()} en version {m.version()}.",
        lambda: f"Il faut savoir si {m.call()} reste dans {m.path()} ou si {c()} prend les {n(2)} étapes.",
        lambda: f"Desde {m.date()} hay {m.count()} filas sueltas en {c()}, por culpa de {m.call()} en la versión {m.version()}.",
        lambda: f"No toquen {m.path()}: {c()} usa {n(2)} campos tras {m.call()}.",
        lambda: f"Queda por ver si {m.call()} sigue en {m.path()} o si {c()} toma las {n(2)} fases.",
        lambda: f"Leave {m.path()} alone, {c()} loads the {w()} by {m.call()} with {n(2)} fields.",
        lambda: f"It takes {m.call()} {n(4)}ms for {n(6)} rows, and {c()} {n(4)}ms for one {m.title()}.",
        lambda: f"// {m.title()} beats {m.title()} by {n(4)} at step {n(1)}.{n(1)}; {m.title()} reports {n(6)}.",
        lambda: f'assert len({w()}) < {n(6)}, "{w()} {w()} {m.hex()}"',
        lambda: f"const {w()} = await {m.call()[:-2]}({w()}, {m.count()}); // {w()} {adj()}",
        lambda: f"def {w()}_{w()}({w()}, limit={m.count()}): return {w()}[{n(2)}:{n(3)}]",
        lambda: f"{opener()} {m.title()} left {m.title()} {n(1)} at {n(2)}.{n(2)}, see {m.title()} {n(5)} and {m.title()}.",
        lambda: f"{opener()} {w()} owner joined {m.title()} in Room {n(3)}; Phase {n(1)}, Build {n(4)}, Port {n(4)}.",
        lambda: f"{opener()} rollback of {m.hex()} took errors to {n(2)}.{n(1)}% with {m.count()} {adj()} rows in {m.path()}.",
        lambda: f"From {m.version()} to {m.version()} {c()} was renamed and {m.call()} {verb()} the {w()} {w()}.",
        lambda: f"{opener()} question about {m.path()}: does {c()} need {m.call()} with {n(2)} {w()}s?",
        lambda: f"{opener()} {w()} of {m.acronym()} {verb()} {m.acronym()}-{n(4)} and {m.acronym()} {n(2)}.",
        lambda: f"My {m.acronym()} is {adj()}, your {m.acronym()} is in the {w()}.",
        lambda: f"{m.syllables(2).capitalize()}ing {m.count()} rows made {m.call()} slow, {c()} {verb()} them.",
        lambda: f"Host {w()}-{n(2)} came up as {m.hex(8)}, session {m.hex(8)}-{m.hex(4)}-{m.hex(4)}-{m.hex(4)}-{m.hex(12)}.",
        lambda: f"uuid {m.hex(6)}{n(2)}-{n(4)}-{n(4)}-{m.hex(4)}-{n(2)}{m.hex(10)} is {adj()}",
        lambda: f"{m.one(['##', '###', '#'])} {w()}: {verb()} the {adj()} {w()} (#{n(5)})",
        lambda: f"{m.one(['##', '###'])} {m.title()} of {m.call()}",
        lambda: f"{m.one(['feat', 'fix', 'chore'])}({w()}): {w()} {verb()} {w()} {m.hex(8)}",
        lambda: f"We {verb()[:-1]} a {adj()} {w()} at {m.town()} in {m.title()} {r.randint(1950, 2030)}.",
        lambda: f"In {m.one(['January', 'March', 'May', 'June', 'August', 'October'])} the {m.title()} of {m.town()} met {m.title()} people.",
        lambda: f"{m.one(['Monday', 'Tuesday', 'Friday', 'Sunday'])} {m.title()} covers {m.title()} in {m.one(['New', 'Old', 'Great'])} {m.title()}.",
        lambda: f"Order {n(4)}-{n(4)} has {n(2)} lines, total {m.count()}.{n(2)} EUR, due {m.date()}.",
        lambda: f"ISBN 978-{n(1)}-{n(3)}-{n(5)}-{n(1)}, pages {n(2)}-{n(3)}, volume {n(2)} ({r.randint(1900, 2030)}).",
        lambda: f"Rule {n(1)}.{n(1)}.{n(2)} allows {n(2)}:{n(2)}:{n(2)} to {n(2)}:{n(2)} on port {n(4)} at 172.{n(2)}.{n(1)}.{n(3)}.",
        lambda: f"The {adj()} {w()} at the {w()} {verb()} at {w()} dot {w()} notation, look at {w()} and at {w()}.",
        lambda: f"Sizes: {n(3)} {n(2)} {n(4)} {n(3)}; ratio {n(1)}.{n(3)}, seed {n(8)}, offset {n(5)}.",
        lambda: f"{opener()} {w()}s {verb()[:-1]} when {n(1)} of {n(2)} {w()}s are {adj()}, and {c()} {verb()} {m.one(['it', 'them', 'that'])}.",
        lambda: f"{opener()} {w()} {w()} that the {w()} {verb()} because a {adj()} {w()} came without any {w()} or {w()}.",
    ]
    if fold is not None:
        frames = [f for i, f in enumerate(frames) if (i % folds == fold) == held]
    text = m.one(frames)()
    return text.upper() if r.random() < 0.04 else text


KINDS = {"n": "person_name", "e": "email", "p": "phone", "i": "identity_number", "a": "street_address"}


def rows(sentences: int = 4000, seed: int = 11, fold: int | None = None, folds: int = 5, held: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(from, to, type)]): each text a sentence of personal data among ordinary ones.

    With a fold, only the frames outside it are used, or, if held, only those in it.
    """
    m, out = Maker(seed), []
    frames = {lang: [f for i, f in enumerate(fs) if fold is None or (i % folds == fold) == held] for lang, fs in WITH.items()}
    ordinary = lambda: plain(m, fold, folds, held)
    while len(out) < sentences:
        text, spans = "", []

        def add(piece: str, kind: str | None = None) -> None:
            nonlocal text
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece

        def sentence() -> None:
            lang = m.one(["en"] * 6 + ["de", "de", "fr", "fr", "es", "es", "xx"])
            words = {"O": OPENERS, "w": NOUNS, "v": VERBS, "V": PAST, "j": ADJ, "f": SMALL, "d": GERMAN, "r": FRENCH, "s": SPANISH, "L": FOREIGN}
            make = {"n": m.name, "e": m.email, "p": lambda: m.phone(lang), "i": lambda: m.identity(lang), "a": lambda: m.address(lang)}
            for piece in re.split(r"(\{[a-zA-Z]\})", m.one(frames[lang])):
                if re.fullmatch(r"\{[nepia]\}", piece):
                    add(make[piece[1]](), KINDS[piece[1]])
                else:
                    add(m.one(words[piece[1]]) if re.fullmatch(r"\{\w\}", piece) else piece)

        breaks = [" ", " ", " ", "\n", "\n// ", "\n> ", "\n\n", "\n- "]
        if m.r.random() < 0.7:
            add(ordinary() + m.one(breaks))
        if m.r.random() < 0.75:
            sentence()
            if m.r.random() < 0.3:
                add(m.one(breaks))
                sentence()
        else:
            add(ordinary())
        if m.r.random() < 0.7:
            add(m.one(breaks) + ordinary())
        # an abbreviated street's dot and the end of a sentence are one dot
        fixed = text.replace("Ave...", "Ave.").replace("Ave..", "Ave.")
        if fixed == text:
            out.append((text, spans))
    return out
