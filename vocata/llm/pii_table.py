"""The labelled table of the personal-information finder, written from neutral patterns.

Patterns are everyday lines of letters, forms, mail headers and notes in six languages;
nothing in them is taken from the texts that the finder is used on. Fillers are random
values of public formats (mail addresses, numbering plans, postal addresses, identity
numbers) and, as far as given, values of structured columns (names, places, phrases,
titles, firms). Patterns
and fillers can be divided into two parts, so that a model trained on one part is tested
on patterns, streets, hosts and number formats that it never met.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Sequence

#: Every pattern and filler whose place in its list is this modulo ``FOLDS`` belongs to the held-out part.
FOLDS, HELD = 4, 3

# Patterns with something personal: {N} name, {E} email, {P} phone, {A} address, {L} {I} label and
# value of an id number. {T} town, {F} firm, {R} title, {S} phrase, {C} and {W} made words with and
# without a capital, {M} month, {Y} year, {D} number fill the line. ^ is a line end.
PERSONAL = {
    "form": """{N}^{E}^{P}
{N}^{A}
{N}^{A}^{P}
{E} | {P}
{E} | {P} | {T}
{P} | {T}
{E} | {T}
{P} / {E}
{E} · {P} · {T}
{T} | {P}
{T}, {C} | {E} | {P}
{N} | {E} | {P}
{N} - {P}
{N}, {P}
{N}; {E}
{N} ({P})
{N} <{E}>
{N} [{E}]
{R}: {N}
{R}: {N}, {P}
{R} {N}, {E}
{W}: {N}
{W}: {N}, {P}
{W}: {N}, {E}
{W} {W}: {N} ({E})
{W} {W} {N}, {A}
{W} {W} {N}^{A}
{W}: {A}
{W}: {A}^{P}
{A}
{A}
{A} / {P}
Ask at {A}
Write to {A} or {E}
Deposit {L} {I}, {L} {I}, {L} {I}
{A}^{E}
{P}
{E}
Name: {N}
Name {N}^Tel. {P}^Mail {E}
Full name: {N}, born {Y}
Phone: {P}
Phone {P} or {P}
Tel {P}
Tel. {P}, fax {P}
T: {P}  M: {P}
Tel {P} / {E}
Mobile {P}
Mobil: {P}
Cell: {P}
Fax: {P}
Email: {E}
Email {E}
E-mail: {E} / {P}
Mail to {E}
Address: {A}
Home address: {A}
Office: {A} (closed {M})
Postal address^{A}
Billing: {N}, {A}
Emergency: {N} ({P})
Tutor: {N}, {P}
Tutor: {N} <{E}>
Witness: {N}
Owner: {N}, {A}
Contact: {N}
Contact: Mr {N}, {P}
Contact : {N}, {E}
Contacto: {N}; {E}
Kontakt: Frau {N}, Tel. {P}
Ansprechpartner: {N}, {E}
Contactpersoon: {N}, {P}
Contato: {N}, {E}
Adresse : {A}
Anschrift: {A}
Adres: {A}
Morada: {A}
Domicilio: {A}
Correo: {E}
Courriel : {E}
Téléphone : {P}
Telefon: {P}
Telefoon: {P}
Teléfono: {P}
Telefone: {P}""",
    "number": """{L}: {I}
{L} {I}
{L}={I}
{L} = {I}
{L} - {I}
{L}: {I}; {L} {I}
{L} no. {I}
{L} nr. {I}
{L} #{I}
{L}, {I}
({L} {I})
id {I}
ID: {I}
id no. {I}
{N}, {L} {I}
{N} - {L}: {I}
{I} ({L})
{L} {I}, valid until {M} {Y}""",
    "mail": """From: {N} <{E}>
To: {N} <{E}>, {N} <{E}>
Cc: {E}
Bcc: {E}; {E}
Reply-To: {E}
From {N} to {N}, {D} {M} {Y}
On {D} {M} {Y}, {N} wrote:
Dear {N},
Hello {N}, thank you for the books.
Best wishes^{N}
Yours, {N}
With thanks, {N}^{R}, {F}^{P}
Attn. {N}, {F}
c/o {N}, {A}
Sent for {N} by {W}
Signed: {N}, {A}
Cher {N}, merci pour la photo.
Lieber {N}, danke für das Bild.
Estimado {N}, adjunto la factura.
Caro {N}, segue a fatura.
Beste {N}, hierbij de foto.""",
    "sentence": """My name is {N} and I rent the small flat.
I am {N} from {T}.
This is {N}, calling about the boiler.
I met {N} at the station.
I spoke with {N} about the garden.
We heard from {N} that the bakery is closed.
Ask {N} at the desk, not me.
Ask for {N} when you arrive.
{N} lent me the ladder.
{N} and {N} sing in the choir.
{N} will bring the chairs.
{N} drives the van on Sundays.
The piano belongs to {N}.
According to {N}, the ferry was late.
Yesterday {N} missed the bus.
Introduced by {N} of {F}.
Painted by {N}, sold by {N}.
He plays chess with {N} every week.
They walked with {N} to the lake.
My landlord Mr {N}, phone {P}, has the keys
The roofer, {N} ({P}), comes at noon.
The tiler, {N} ({E}), comes on Monday.
Our plumber ({N}, {P}) is on holiday.
The keys are with {N}, {A}, or ring {P}.
If lost, return to {N} at {E}.
Send the parcel to {N}, {A}.
Ring {N} on {P} after lunch.
Ring {P} after lunch
Dial {P} for a table.
Text {P} or mail {E}.
My number is {P}, my mail is {E}.
You can write to me at {E} or ring {P}.
Bring it by {D} o'clock or call {P} first
Orders go to {E}
We sit at {E} all week, write at any hour.
Reach us at {E} or drop in at the {W} shop.
The {W} {W} answers at {E}
Photos: {E}
Anything about the flat: {N}, {E}
The card on the gate read {N}, {P}.
I live at {A} and like it.
We lived at {A} until {Y}.
He grew up at {A}.
The cat was found near {A} on {D} {M}.
Send flowers to {A}
Parcels to {A}, please.
Bring the bike to {A}
Deliver to {A} before {D} {M}.
The old house, {A}, was sold in {Y}.
My {L} is {I}.
My {L} is {I}, issued in {T}.
Her {L} ({I}) was never asked for.
He gave {L} {I} at the border.
The lost purse held a card with {L} {I}.
The clerk typed {L} {I} twice.
The form shows {L} {I}, and the street {A}
It had the {L}, {L}={I}
Je m'appelle {N} et j'habite {A}.
J'ai parlé avec {N} au marché.
Merci d'écrire à {N}, {E}
Appelez {N} au {P} le soir.
Le colis part chez {N}, {A}.
Mon {L} est le {I}.
Ich heiße {N} und wohne in der {A}.
Gestern sprach ich mit {N} über den Hund.
Frau {N} ist unter {P} zu erreichen.
Bitte an {E} oder an {A} senden.
Meine {L} lautet {I}.
Me llamo {N} y vivo en {A}.
Hablé con {N} en la plaza.
Llame a {N} al {P} por la tarde.
Mande las flores a {A} o escriba a {E}
Mi {L} es {I}.
Chamo-me {N} e moro na {A}.
Falei com {N} na praia.
Ligue para {N}, {P}, depois do almoço.
O meu {L} é {I}.
Ik heet {N} en woon op {A}.
Ik sprak met {N} over de tuin.
Bel {N} op {P} na het eten.
Mijn {L} is {I}.""",
}

# Lines without anything personal. {K} {J} label and value of a number that names no person.
NEUTRAL = {
    "list": """{S}, {S}, {S}, {S}
{S}, {S}
{S}
{W}: {S}, {S}, {S}
{W} {W}: {S}, {S}, {S}, {S}
{W}: {W}, {W} and {W}
{R}
{R}
{R}, {T}
{F} | {T}, {C}
{F} | {T}, {C}
{F} | {T}
{R} - {F} ({M} {Y} - {M} {Y})
{R} at {F}, {Y} to {Y}
{R} - {F} ({M} {Y} - Present)
{R}, {F}, since {M} {Y}
{T}, {C}
{T}, {T} and {T}
BSc in {S} - {T} University ({Y})
MA in {W} {W}, {C} College, {Y}
{S} Level {D}
Project: {W} {W} {W}
Skills
SKILLS
Summary
PROFILE
EDUCATION
EXPERIENCE
PROJECTS
Hobbies
REFERENCES
PERSONAL
Übersicht
Ausbildung
Formation
Estudios
Opleiding
ABOUT {C}
{C}
{C} {C}
{W} {W}
{K} {J}
{K} {J} / {J}
{K}: {J}
{K} {J}, {W}
{K} no. {J}
{K} {J} of {D} {M} {Y}
{D}.{D}.{D}
{H} - {H}
{H}-{H}, {W} {D}, {T}
{W} {H}-{H}, {W} {D}, {T}
{C} {H} - {H}, {T}, {W} {D}
{W} {H}-{H} {W}, {W} {H}
{D} {M} {Y} - {D} {M} {Y}
{Y}-{Y}, grade {D}
{D},000 - {D},000 {W} a year
{D} km, {D} m, {D} kg
@{W}{W}
#{W}{W}
{S} ({S})
{S} / {S}
{W} {S} {W} {S}
{R} / {R}
{R} {W} {R}
{R} ({W})
{R}, {F}, {T}
see https://{W}.example/{W}/{D}""",
    "sentence": """The {W} train leaves at {D} and the {W} bus at {D}.
{D} of {D} {W} lamps are broken.
The {W} {W} was moved to {M}.
We baked {D} loaves and sold {D} before noon.
In {Y} the library bought {D} maps of {T}.
{F} sells boats and {W} ropes.
{F} is closed on Mondays.
The museum in {T} shows {D} clocks.
The {R} and the {R} share a {W} desk.
This {R} {W} a {W} {W}; a {R} never {W}.
Every {R} knows {S} and some {S}.
A {R} earns about {D},000 a year here.
{C} {C} took the cup in {Y}.
Nobody had cleaned the {W} pond before the {W} party.
She learned {S} during a {W} winter.
They used {S} and {S} to plan the {W} trip.
Without {S} the {W} boat would never float.
The {W} choir and the {W} band share a hall for {D} days.
If the {W} soup is cold, tell the cook at once.
You need {D} eggs, {D} cups of milk and a {W} pan.
Turn left at the {W} mill, then walk {D} minutes.
I stopped because my {W} knee hurt after the {W} run.
Our {W} team meets in a {W} barn every Friday.
Two {W} horses and {D} {W} geese crossed the road.
From {M} to {M} the {W} road is icy, mind the {W} bend.
At {H} the {W} bell rang {D} times.
The {W} kettle, {W} and {W}, stood beside the {W} window and the {W} lamp.
The {W} {W} {W}. {C} {W} the {W} {W}. {C} {W} {W}.
{C} a {W} {W} with the {W} {W}. {C} {W}, then {C}.
They {W} a {W} {W} and {W} a {W} {W}.
Give it to a {W} of {W} or to a {W}, not to a {W}.
For a {W}, with a {W}, by a {W} {W}, like a {W}.
Some {W} {W} of a {W} {W} over {W} {W}.
L'{W} et l'{W} restent près de l'{W}, d'{W} en {W}.
J'ai vu qu'{W} n'était pas l'{W} de {W} pendant l'{W}.
{W} {W}, l'{W} avec l'{W} du {W} d'{W}.
The price rose from {D} to {D}{D} in {D} weeks, or {D} percent.
Chapter {D} tells how a {W} baker built a {W} oven.
{K} {J} was paid in {M}.
The {W} label said {K} {J}, nothing else.
{K} {J} arrived with {D} {W} scratches.
{M} {Y} was {W}, {M} was {W} and {M} dry.
Le {W} train part à {D} heures de {T}.
Nous avons vendu {D} pains avant midi, et {D} après.
La {W} porte reste fermée pendant {D} jours.
Avec {S}, le {W} jardin a gagné {D} roses.
{F} répare des vélos et des montres.
Elle chante bien, mais elle n'aime pas la {W} scène.
Der {W} Zug fährt um {D} Uhr nach {T}.
Wir haben {D} Brote gebacken und {D} verkauft.
Durch {S} wurde der {W} Garten um {D} Prozent grüner.
Der {C} hat das {C} und den {C} in zwei {C} gelegt.
Wegen der {C} kam die {C} mit dem {C} zu den {C}.
Die {W} Tür bleibt {D} Tage zu, sagt die {C}.
{F} baut Boote und repariert Uhren.
Am Montag singt der Chor im {C}, am Freitag im Saal.
El {W} tren sale a las {D} hacia {T}.
Vendimos {D} panes y {D} tartas en {M}.
La {W} puerta queda cerrada {D} días.
Con {S} el jardín tiene un {D} por ciento más de rosas.
{F} arregla relojes y bicicletas.
O {W} comboio parte às {D} para {T}.
Vendemos {D} pães e {D} bolos em {M}.
Com {S} o jardim ganhou {D} rosas.
A {W} porta fica fechada {D} dias.
De {W} trein vertrekt om {D} uur naar {T}.
We bakten {D} broden en verkochten er {D}.
Met {S} werd de tuin {D} procent groener.
De {W} deur blijft {D} dagen dicht.""",
}
KIND = {"N": "name", "E": "email", "P": "phone", "A": "address", "I": "id_number"}

# Common given names and surnames, street words and number labels of several countries.
GIVEN = (
    "Anna Maria Jan Peter Emma Louis Sofia Carlos Ines Pedro Lucas Julia Thomas Sarah David Laura Paul Marta Hans Greta Pierre Claire Antoine Camille Miguel Carmen Pablo Lucia Joao Ana Rui Beatriz "
    "Daan Sanne Bram Lotte Pieter Femke John Mary James Susan Robert Linda Ahmed Fatima Wei Mei Raj Priya Igor Olga Kofi Ama Yuki Kenji Chloé Zoë José Jürgen"
).split()
SURNAMES = (
    "Smith Jones Brown Taylor Wilson Evans Walker Wright Green Hall Clarke Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Martin Bernard Dubois Moreau Laurent Girard Lefebvre "
    "García López Martínez Sánchez Romero Torres Silva Santos Ferreira Pereira Costa Almeida Jansen Bakker Visser Smit Mulder Kowalski Novak Rossi Ricci Okafor Mensah Khan Patel Singh Chen Wang Tanaka Sato Ivanov Petrov O'Brien Saint-Clair"
).split()
STREETS = "High Main Station Church Park Mill Oak Elm Bridge Castle Market School North Victoria King's Queen's London River Forest Spring Garden Lake".split()
STREET_KINDS = "Road Street Lane Close Avenue Drive Court Terrace Place Square Way Crescent Grove Hill Rd. St. Ave Ave. Blvd. Ln Dr. Row".split()
STREETS_DE = "Haupt Bahnhof Garten Berg Schul Linden Birken Kirch Mühlen Wiesen Schiller Goethe Markt Ring Ufer Tal".split()
STREET_KINDS_DE = "straße str. weg gasse platz allee strasse ring damm ufer".split()
STREETS_FR = "de la Gare|Victor Hugo|de la République|des Écoles|du Moulin|de l'Église|du Château|des Lilas|Pasteur|du Port|des Fleurs|Saint-Michel".split("|")
STREET_KINDS_FR = "rue avenue boulevard place impasse chemin allée quai cours route".split()
STREETS_ES = "Mayor|del Sol|de la Paz|Real|de Cervantes|San Juan|de la Constitución|del Carmen|Nueva|del Prado".split("|")
STREETS_NL = "Kerk Dorps Molen Station Juliana Beatrix School Nieuw Wilhelmina Oranje".split()
DOMAINS = "com org net co.uk de fr es nl pt eu info io ch at be example test invalid example.org example.com example.net".split()
HOSTS = "mail post box webmail inbox home office letters study net town".split()
# A label of an id number is a kind, at times with a word before and a word for number behind.
ID_WORDS = {
    "en": ("social health national tax state personal my", "insurance security tax identity passport id residence permit licence", "number no. no card nr # id"),
    "de": ("persönliche deutsche meine", "Steuer Sozialversicherung Rentenversicherung Krankenkasse Ausweis Personalausweis Reisepass Führerschein", "Nummer Nr. -Nr. -ID -Nummer"),
    "fr": ("le mon votre", "sécurité-sociale sécu identité passeport fiscal assurance carte", "numéro n° no"),
    "es": ("mi su el", "DNI NIE NIF pasaporte seguridad-social fiscal", "número núm. n.º"),
    "pt": ("o meu", "NIF contribuinte passaporte cidadão", "número n.º"),
    "nl": ("mijn uw het", "BSN burgerservice paspoort identiteit rijbewijs", "nummer nr."),
}
ID_SHORT = "SSN NI NINO TIN EIN ITIN NHS NIR INSEE DNI NIE NIF NISS BSN SVNR IdNr PPS SIN AHV CPF NRIC".split()
# @ is a letter, # a digit: postcodes; social security, insurance, tax, identity card and passport numbers of several countries.
POSTCODES = "@@# #@@|@@# #@@|@## #@@|@@## #@@|@@#@ #@@|@@# #@@|@@ #####|#####|@@ #####|#####|#### @@|####-###|####|@#@ #@#|#####-####|@-####|@# #@@|##-###|@@#####".split("|")
ID_FORMS = (
    "###-##-####|### ## ####|9##-##-####|##-#######|@@ ## ## ## @|@@######@|@@ ###### @|## ### ### ###|###########|## ###### @ ###|##/###/#####|# ## ## ## ### ### ##|#############|########@|########-@|@#######@|@-#######-@|"
    "#########|### ### ###|@########|@@#######|@#######|@@@######|@##@##@##|####.##.###|###.####.####.##|###.###.###-##|##.##.##-###.##|@@ ### ####|###### ## ###|@@-######"
).split("|")
OTHER_LABELS = (
    "code invoice order batch ref ref. reference ticket article part serial version model case room chapter clause lot tracking job item page release build flight gate seat bus line plot "
    "Rechnung Auftrag Artikel Zimmer facture commande lot chambre factura pedido sala fatura encomenda factuur bestelling kamer"
).split()
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec January March April June July October Mai Oktober mars août enero mayo maio maart".split()
FIRMS = "Ltd Inc GmbH SA BV Group Bank Stores Motors Media Energy Systems Labs Partners Holdings Logistics Insurance Health Airlines Hospital Institute Council University Software Textiles Brothers Pharma Telecom".split()
RANKS = "Junior Senior Lead Chief Head Deputy Assistant Interim Associate Principal Trainee".split()
TRADES = "Manager Analyst Engineer Scientist Planner Officer Nurse Teacher Cook Driver Clerk Designer Editor Developer Consultant Technician Accountant Buyer Librarian Surveyor".split()
SUBJECTS = "Sales Data Music Paper Garden Night Office Water Field Product Travel Quality Report Risk Energy Finance Railway Harbour".split()
# Signs between fields, forms of address, words with which a sentence goes on after a value.
SEPARATORS = (" | ", " / ", "; ", ", ", " - ", " · ", " – ", " • ", "\t", "  ")
TITLES = "Mr Mrs Ms Dr Mr. Mrs. Ms. Dr. Prof. Herr Frau M. Mme Mlle Sr. Sra. Sr Sra Don Dona Dhr. Mevr. Miss Sir".split()
LINKS = "on before after since until at with for near from in and or to by y und et e en am bis seit près avec desde hasta con até com bij met van".split()
PRODUCTS = "Cloud Studio Server Suite Desk Kit Office Pro Plus Online Mobile Engine Hub Player Writer Maps Mail Viewer Manager Designer".split()
_SYLLABLES = "ba ke lo mi nu ra so ti vu der len mar nor quin ster thal vik wen zor ash bel cor dra fen gri hol jor pel sim tan ul wick yar zen or an el is".split()


def half(items: Sequence, held: bool | None) -> list:
    """All items, or those of the training part (False) or of the held-out part (True)."""
    return [x for i, x in enumerate(items) if held is None or (i % FOLDS == HELD) == held]


def patterns(group: dict[str, str], held: bool | None = None) -> list[list[str]]:
    """Patterns of each kind of a group, in the part asked for."""
    return [half(v.split("\n"), held) for v in group.values()]


class Fillers:
    """Random values for the places of a pattern; ``held`` selects the part of streets, hosts and formats."""

    def __init__(self, rng: random.Random, names: Sequence[str], places: Sequence[str], phrases: Sequence[str], titles: Sequence[str], firms: Sequence[str], held: bool | None = None):
        self.rng = rng
        self.names, self.places, self.phrases, self.titles, self.firms = (half(sorted(x), held) for x in (names, places, phrases, titles, firms))
        kept: dict[int, list] = {}
        self.part = lambda xs: kept[id(xs)] if id(xs) in kept else kept.setdefault(id(xs), half(xs, held))
        self.of: dict[str, Callable[[], str]] = {
            "N": self.name, "E": self.email, "P": self.phone, "A": self.address, "T": self.town, "F": self.firm, "R": self.title, "S": self.phrase, "C": self.made, "W": self.word,
            "H": lambda: f"{self.num(0, 24):0{self.num(1, 3)}d}:{self.pick(['00', '15', '30', '45', self.digits(2)])}", "M": lambda: self.pick(MONTHS), "Y": lambda: str(self.num(1950, 2030)), "D": lambda: str(self.num(1, 10 ** self.num(1, 4))), "L": self.id_label, "I": self.id_number, "K": self.other_label, "J": self.other_number,
        }

    def pick(self, xs):
        return self.rng.choice(xs)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def num(self, low: int, high: int) -> int:
        return self.rng.randrange(low, high)

    def digits(self, n: int) -> str:
        return "".join(self.rng.choices("0123456789", k=n))

    def masked(self, form: str) -> str:
        return re.sub("[#@]", lambda m: self.digits(1) if m[0] == "#" else chr(65 + self.num(0, 26)), form)

    def word(self) -> str:
        return "".join(self.pick(_SYLLABLES) for _ in range(self.num(1, 4)))

    def made(self) -> str:
        return "".join(self.pick(_SYLLABLES) for _ in range(self.num(2, 4))).capitalize()

    def parts(self, known: bool = False) -> tuple[str, str]:
        """Given name and surname; ``known`` ones are of the lists and columns alone."""
        if self.names and self.chance(0.6):
            n = self.pick(self.names).split()
            if len(n) > 1:
                return n[0], n[-1]
        a = self.pick(self.part(GIVEN)) if known or self.chance(0.6) else self.made()
        b = self.pick(self.part(SURNAMES)) if known or self.chance(0.5) else self.made()
        if self.chance(0.1):
            b += "-" + self.made()
        elif self.chance(0.04):
            b = self.pick(["O'", "D'"]) + self.made()
        return a, b

    def name(self) -> str:
        case = self.rng.random()
        a, b = self.parts(known=case > 0.9)  # in lower case only a known name can be told from other words
        initial = f"{chr(65 + self.num(0, 26))}."
        forms = [f"{a} {b}"] * 10 + [f"{b}, {a}", f"{b}, {a}", f"{a[0]}. {b}", f"{a[0]}. {b}", f"{a} {initial} {b}", f"{a} {initial} {b}", f"{a[0]}. {initial} {b}", f"{b}, {a[0]}.", f"{b} {a}", f"{a} {self.made()} {b}"]
        s = self.pick([f"{a} {b}", f"{a} {b}", f"{b}, {a}"] if case > 0.9 else forms)
        return s.upper() if case < 0.12 else s.lower() if case > 0.9 else s

    def email(self) -> str:
        a, b = (x.lower().replace("'", "") for x in self.parts())
        n = self.digits(self.num(0, 5))
        local = self.pick([f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a[0]}{b}", f"{a[0]}.{b}", f"{a}{b[0]}", f"{a}{b}", f"{b}.{a}", a, b, f"{b}+{self.word()}", f"{self.word()}.{self.word()}"]) + n
        host = self.pick([self.made().lower(), self.made().lower(), f"{self.word()}-{self.word()}", self.pick(self.part(HOSTS)), f"{self.pick(self.part(HOSTS))}.{self.made().lower()}", self.made().lower() + self.pick(self.part(HOSTS))])
        full, form = f"{host}.{self.pick(self.part(DOMAINS))}", self.rng.random()
        if form < 0.6:
            s = f"{local}@{full}"
        else:
            at = self.pick([" at ", " (at) ", " [at] ", " at ", "(at)", "[at]", " {at} "])
            dot = self.pick([".", " dot ", " dot ", " [dot] ", " (dot) ", " (dot) " if "(" in at else " dot "])
            s = f"{local}{at}{full.replace('.', dot)}"
        return s.upper() if self.chance(0.1) else s

    def phone(self) -> str:
        sep = self.pick([" ", " ", "-", ".", ".", "", " "])
        start = self.rng.random()
        groups = [self.digits(self.num(2, 5) if self.chance(0.9) else self.num(5, 8)) for _ in range(self.num(1, 5))]
        area = self.pick([self.digits(2), self.digits(3), self.digits(3), "0" + self.digits(1), "0" + self.digits(2), "0" + self.digits(3)])
        if start < 0.35:
            code = self.pick(["+", "+", "00"]) + str(self.num(1, 10 ** self.num(1, 4)))
            gap = self.pick([" ", sep, sep])
            s = code + gap + self.pick([area, area.lstrip("0") or "1", f"({area})", f"(0){area.lstrip('0') or '1'}"]) + self.pick([sep, gap]) + sep.join(groups)
        elif start < 0.6:
            s = f"({area}){self.pick([' ', ' ', '', '-'])}" + self.pick([sep, "-"]).join(groups)
        elif start < 0.7:
            s = area + self.pick(["/", " / ", "-"]) + sep.join(groups)
        else:
            s = sep.join([area, *groups])
        n = sum(c.isdigit() for c in s)
        return s if 7 <= n <= 15 else self.phone()

    def id_number(self) -> str:
        if self.chance(0.6):
            return self.masked(self.pick(self.part(ID_FORMS)))
        sep, groups = self.pick(["", " ", "-", "-", " ", "/"]), []
        for _ in range(self.num(1, 5)):
            groups.append(self.pick(["##", "###", "####", "###", "#####", "#######", "@@", "@", "@##", "##@", "@@##"]))
        form = sep.join(groups) + (self.pick(["@", "@", sep + "@"]) if self.chance(0.3) else "")
        return self.masked(form) if form.count("#") >= 6 and form.count("#") <= 16 else self.id_number()

    def id_label(self) -> str:
        if self.chance(0.3):
            s = self.pick(self.part(ID_SHORT))
            return s + self.pick(["", "", "", " number", " no.", "-Nr.", " nr", "-no"])
        before, kind, behind = (x.split() for x in ID_WORDS["en" if self.chance(0.3) else self.pick(list(ID_WORDS))])
        s = self.pick(kind).replace("-", " ")
        if self.chance(0.55):
            s = f"{self.pick(before)} {s}"
        if self.chance(0.6):
            end = self.pick(behind)
            s += end if end.startswith("-") else f" {end}"
        case = self.rng.random()
        return s.title() if case < 0.3 else s.capitalize() if case < 0.5 else s.upper() if case < 0.58 else s

    def other_label(self) -> str:
        s = self.pick(self.part(OTHER_LABELS))
        return s.capitalize() if self.chance(0.4) else s.upper() if self.chance(0.1) else s

    def other_number(self) -> str:
        sep, groups = self.pick(["-", "/", ".", "", "-"]), []
        for _ in range(self.num(1, 5)):
            groups.append(self.pick(["#", "##", "###", "####", "20##", "@@", "@", "@#"]))
        s = groups[0]
        for g in groups[1:]:
            s += (sep or "-" if len(groups) > 2 else sep) + g
            sep = self.pick(["-", "/", "."]) if self.chance(0.3) else sep
        s = self.masked(s)
        return s if any(c.isdigit() for c in s) else s + self.digits(2)

    def town(self) -> str:
        if self.places and self.chance(0.5):
            return self.pick(self.places).split(",")[0]
        return self.made() + self.pick(["", "", "", "-" + self.made(), " " + self.made(), " am " + self.made(), "-sur-" + self.made()])

    def postcode(self) -> str:
        return self.masked(self.pick(self.part(POSTCODES)))

    def address(self) -> str:
        style = self.rng.random()
        n = str(self.num(1, 10 ** self.num(1, 5)))
        if style < 0.6:
            road = self.pick([self.pick(self.part(STREETS)), self.made(), self.made(), f"{self.made()} {self.made()}", f"{self.made()} {self.pick(['Hill', 'Green', 'Gate', 'End'])}", f"{self.pick(['Old', 'Upper', 'Great', 'New', 'West', 'Little'])} {self.made()}"])
            kind = self.pick(self.part(STREET_KINDS))
            s = f"{n}{self.pick(['', '', '', '', '', '', 'a', 'B', ' c'])} {road} {kind}"
            if self.chance(0.4):
                unit = f"{self.pick(['Flat', 'Apt', 'Apt.', 'Unit', 'Suite', 'Floor', 'Room', 'Apartment'])} {self.pick([self.digits(1), self.digits(2), self.digits(1) + self.pick('ABC'), self.pick('ABCD')])}"
                s += self.pick([f", {unit}", f", {unit}", f" {unit}", f" #{self.digits(self.num(1, 4))}"])
            if self.chance(0.07):
                return s
            join = self.pick([", ", ", ", "\n"])
            return s + join + self.pick([f"{self.town()} {self.postcode()}", f"{self.town()} {self.postcode()}", f"{self.town()}, {self.postcode()}", f"{self.town()}, {self.postcode()}", self.town()])
        house = f"{self.num(1, 200)}{self.pick(['', '', '', 'a', ' b', '-' + str(self.num(2, 99)), ' bis', ' C'])}"
        if style < 0.73:
            stem = self.pick([self.pick(self.part(STREETS_DE)), self.made(), self.made()])
            s = self.pick([stem + self.pick(self.part(STREET_KINDS_DE)), stem + self.pick(self.part(STREET_KINDS_DE)), f"{stem}er {self.pick(['Straße', 'Weg', 'Allee', 'Str.'])}", f"{self.pick(['Am', 'An der', 'Im'])} {self.made()}"]) + f" {house}"
        elif style < 0.86:
            tail = self.pick([self.pick(self.part(STREETS_FR)), f"{self.pick(['de', 'du', 'des', 'de la', 'des'])} {self.made()}", f"{self.pick(['des', 'du', 'de la'])} {self.made()}-{self.made()}"])
            s = f"{house}{self.pick(['', '', ','])} {self.pick(self.part(STREET_KINDS_FR))} {tail}"
        elif style < 0.95:
            tail = self.pick([self.pick(self.part(STREETS_ES)), f"{self.pick(['de', 'del', 'de los', 'de la', ''])} {self.made()}".strip(), f"{self.made()} {self.made()}"])
            s = f"{self.pick(['Calle', 'Calle', 'C/', 'Avenida', 'Av.', 'Plaza', 'Paseo', 'Rua', 'Rua', 'Travessa'])} {tail}{self.pick([' ', ', '])}{house}"
            if self.chance(0.6):
                s += f", {self.pick('123456')}{self.pick(['.º', 'º', 'ª', '.ª'])} {self.pick(['A', 'B', 'C', 'D', 'izq.', 'dcha.'])}"
        else:
            s = f"{self.pick([self.pick(self.part(STREETS_NL)), self.made()])}{self.pick(['straat', 'laan', 'weg', 'plein', 'gracht', 'kade'])} {house}"
        if self.chance(0.1):
            return s
        return s + self.pick([", ", ", ", ", ", "\n"]) + self.pick([f"{self.postcode()} {self.town()}", f"{self.postcode()} {self.town()}", f"{self.digits(5)} {self.town()}", f"{self.digits(5)} {self.town()}"])

    def firm(self) -> str:
        if self.firms and self.chance(0.5):
            return self.pick(self.firms)
        stem = self.pick([self.made(), self.made(), self.parts()[1], f"{self.made()} {self.made()}"])
        return f"{stem} {self.pick(self.part(FIRMS))}{self.pick(['', '', '', ' ' + self.pick(self.part(FIRMS))])}"

    def title(self) -> str:
        if self.titles and self.chance(0.5):
            return self.pick(self.titles)
        s = f"{self.pick([self.pick(self.part(SUBJECTS)), self.pick(self.part(SUBJECTS)), self.made()])} {self.pick(self.part(TRADES))}"
        return self.pick(["", "", self.pick(self.part(RANKS)) + " "]) + s + self.pick(["", "", "", " II", " III"])

    def phrase(self) -> str:
        if self.phrases and self.chance(0.6):
            return self.pick(self.phrases)
        if self.chance(0.4):
            return f"{self.made()} {self.pick(self.part(PRODUCTS))}"
        return " ".join(self.pick([self.made(), self.made(), self.pick(self.part(SUBJECTS)), self.pick(self.part(TRADES)) + "s"]) for _ in range(self.num(1, 4)))


def labelled_lines(names: Sequence[str], places: Sequence[str], phrases: Sequence[str], docs: int, seed: int = 11, held: bool | None = None, titles: Sequence[str] = (), firms: Sequence[str] = (), plain: bool = False) -> list[list[tuple[str, str]]]:
    """The labelled table: documents as ``(text, type or "")`` runs.

    ``held`` None takes all patterns and fillers, False those of the training part, True
    those of the held-out part alone. Unless ``plain``, patterns are varied: other signs
    between fields, unknown words, going on after a value, lines in capitals.
    """
    rng = random.Random(seed)
    fill = Fillers(rng, names, places, phrases, titles, firms, held)
    have, have_not = patterns(PERSONAL, held), patterns(NEUTRAL, held)

    def line(pattern: str, gap: str) -> list[tuple[str, str]]:
        out, other = [], fill.pick(SEPARATORS) if not plain and rng.random() < 0.5 else ""
        pieces = re.split(r"(\{\w\}|\^)", pattern)
        for i, piece in enumerate(pieces):
            key = piece[1:-1] if piece.startswith("{") else ""
            text = gap if piece == "^" else fill.of[key]() if key else other if other and piece in SEPARATORS else piece
            if key == "N" and rng.random() < 0.12:
                out.append((fill.pick(fill.part(TITLES)) + " ", ""))
            if text:
                out.append((text, KIND.get(key, "")))
            after = pieces[i + 1][:1] if i + 1 < len(pieces) else ""
            if key in KIND and after in ("", " ") and not plain and rng.random() < 0.12:  # the sentence goes on
                out.append((f" {fill.pick(LINKS)} {fill.pick([fill.word, fill.word, fill.made, fill.of['Y'], lambda: fill.of['D']() + ' ' + fill.of['M'](), lambda: fill.word() + ' ' + fill.word()])()}", ""))
        if not plain and rng.random() < 0.3:  # words that the model does not know stand where it knows some
            out = [(re.sub(r"\b[a-z]{3,}\b", lambda m: fill.word() if rng.random() < 0.3 else m[0], t), k) if not k else (t, k) for t, k in out]
        if not plain and rng.random() < (0.2 if "{R}" in pattern or "{F}" in pattern else 0.06):
            out = [(t if k in ("email", "id_number") else t.upper(), k) for t, k in out]
        return out

    table = []
    for _ in range(docs):
        runs: list[tuple[str, str]] = []
        bullet, gap = fill.pick(["", "", "- ", "  - ", "* ", "• ", "– ", "+ ", "▪ ", "1. "]), fill.pick(["\n", "\n", "\n", "\r\n", " ", "   \n"])
        if rng.random() < 0.4:  # a letterhead or resume starts with the name
            runs += [(fill.name(), "name"), (gap, "")]
        n = rng.randrange(3, 10)
        for _ in range(n):
            group = have if rng.random() < 0.55 else have_not
            weights = [0.36, 0.16, 0.08, 0.4] if group is have else [0.45, 0.55]
            body = line(fill.pick(rng.choices(group, weights)[0]), gap)
            if rng.random() < 0.4 and bullet:
                runs.append((bullet, ""))
            end = fill.pick(["", " ", ".", " ;", ",", " |", "!"]) if rng.random() < 0.3 else ""
            runs += [*body, (end + (gap + gap if rng.random() < 0.15 else gap), "")]
        table.append([r for r in runs if r[0]])
    return table
