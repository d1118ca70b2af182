"""The small labelled table of the personal-data model: invented sentences whose mentions are marked, in four languages.

Sentences, surnames, streets, towns and firms were written for this table; none is taken from a corpus the model is run on.
"""

from __future__ import annotations

import random
import re

#: Rows of the table. The bound holds whatever the size of the corpus.
ROWS = 6000

# Common given names and short forms, used for a lexical feature and in the labelled sentences.
GIVEN = (
    "adam adele agnes alan albert alex alexander alice alma alois amelie ana andrea andreas andrew anja anna anne anton antonio arthur barbara beate ben benjamin bernd bernhard bill birgit björn bjorn bob brigitte bruno camille carla carlos carmen carol caroline "
    "catherine charles charlotte chris christian christine christopher claire clara claudia dan dani daniel daniela dave david diana diego dieter dominique dora ed edgar edith edward elena eliza elizabeth ella ellen emil emily emma enrique eric erik ernst esther eva "
    "fatima felix fernando frances francis françois francois frank fred freddie frederick gabi gabriel gabriela gabriele george gerd greta guillermo gustav hannah hanna hans harold harry heike helen helena henri henrietta henry hetty hugo ian ines inga inge ingrid irene "
    "isabel ivan jack jacob jacques james jan jane jean jen jennifer jim joan joe johan john jon jonas jonathan jorge josé jose josef joseph juan judith julia julie karin karl kate katherine kathy katie kim klaus kurt lars laura laurent lena leo leonard linda lisa liz lou louis louise luc "
    "lucia luis luisa maggie manuel marc marco margaret maria marie mario mark marta martin mary matt matthew max meg michael michel mick miguel mike mohammed monica nadia nathan ned nicholas nick nicolas nina nora olga oliver oscar otto pablo paco pat patricia patrick patty paul paula pedro peggy "
    "pepe peter phil philip philippa pip pippa quentin rachel ralf raymond rebecca richard rita rob robert roger rosa ruth sam samuel sandra sarah sebastian silke simon sofia sophie stefan stephan stephen steve sue susan susanna susi suzy sven ted theo theodore thomas tim tina tom tomás tony "
    "udo ulrich ursula urs uwe vera vicky victor victoria vince vincent walter wendy werner wilhelm will william wolfgang xavier yann yolanda yusuf yves zoe zoë zoé"
).split()

# {n} a person, {e} a mailbox, {p} a phone, {i} a number of a document, {a} an address; other braces are unmarked filler.
_EN = [
    "My neighbour {n} keeps bees.", "We thanked {n} for the cake.", "{n} missed the bus again.", "Minutes taken by {n}, seconded by {n}.", "Yesterday {n} and {n} painted the fence.", "Dr. {n} will see you at nine.", "Mrs. {n} taught us piano.", "Prof. {n}, who retired, still writes.", "Mr. {n} owns the mill.",
    "Photo: {n}", "Editor: {n}", "{n}", "- {n}", "{n}, treasurer", "Signed, {n}", "Best wishes, {n}", "Hello {n}, how are you?", "To: {n} <{e}>", "cc: {e}", "Mail {e} with any doubts.", "Reply to {e} or ring {p}.", "{e} is the shared inbox.", "My old mailbox, {e}, is dead.", "Forward it to {n} ({e}).", "{e}",
    "Ring {p} after lunch.", "Mobile {p}", "Tel: {p}", "T {p} / F {p}", "Our number is {p}, ask for {n}.", "Text {p} to cancel.", "{p}", "Reach {n} on {p} or at {e}.", "Emergency line {p} is staffed all night.", "Leave a message on {p}.", "Phone {p}; mail {e}.",
    "Passport {i} expired.", "The clerk copied SSN {i} into the file.", "Her passport number was {i}.", "Tax ID: {i}", "Licence {i} belongs to {n}.", "{n} carries residence card {i}.", "National insurance no. {i}", "He showed us card {i} and left.", "Insured under {i} since birth.", "Permit no. {i} was revoked.", "Holder {n}, document {i}, phone {p}.", "{n}, holder of {i}, was late.", "with document {i}.",
    "The parcel for {n} went to {a}.", "We moved to {a} in spring.", "{a}", "Address: {a}", "Visit us at {a}!", "{n} rents a room at {a}.", "Invoices: {n}, {a}.", "Meet me outside {a}.", "Home: {a}; work: {a}", "Return to {a}, please.", "The will of {n}, late of {a}, was read.", "He lived at {a} and his number was {i}.", "Deliver to {n}, {a}, and phone {p}.",
    "Nobody told {n}.", "We gave {n} a {word}.", "I sent {n} the {word} by boat.", "Let {n} a room.", "Give {n} {d2} {word}s.", "I met {n} a week ago.", "They showed {n} a {word} in {town}.", "Call {p} and wait.", "Dial {p} today.", "I texted {p} twice.", "{doc} {i} is lost.", "My {doc} {i} got wet.", "She sold {doc} {i}?", "His {doc} was {i}, I think.", "Go to {a} at noon.", "We left {a} in haste.", "The flat at {a} is cold.", "Leave it at {a}.", "Before that, {n} ran a bakery.", "In {town}, {n} met {n}.", "Was it {n} who called?", "As {n} put it, rain is likely.", "“I never saw it,” said {n}.", "The letter from {n} arrived.", "{n} said no.", "says {n} of {firm}.", "Posted by {n} on {day}", "{n} wrote back from {town}.", "Contact {n}.", "Contact {n} for the {word}.", "Contact {n} for {word}s.", "Contact {n}: {e}.", "Contact {n} or {n} first.", "Dear {n}, the {word} is yours.", "Ask Dr. {n} or Mrs. {n}.", "Mr. {n} and {n} agreed.", "The {word} goes to {n} now.", "Has {n} paid for {make}?", "{n} of {firm} left {town}.", "{n} and {n} ran {make} for years.",
    "{n} has {doc} {i}.", "{n} quoted {doc} {i}.", "{n} presented {doc} {i} today.", "{doc} {i}, issued in {town}", "Bring {doc} {i} along.", "His {doc}, {i}, is blocked.", "We need {doc} {i} for {n}.", "{n} moved to {a}; {doc} {i}.", "under {doc} {i}. {make} is slow.", "{doc}: {i}", "the {doc} {i} of {n}",
    "or dial {p}.", "It rings on {p} until ten.", "{n} answers {p} and {e}.", "Try {p}, then {p}.", "or call {p}. {n} knows.", "At {a}, ring twice.", "{a}: two rooms", "{n}, {a}, {town}", "Parcels for {a} wait.", "{n} lives near {a} with {n}.", "Take {doc} {i} to {a}.", "{n} of {a} showed {doc} {i}.", "{n} showed {doc} {i} at noon.", "{n} needs the {doc} {i}.", "Check: {doc} {i}, tel. {p}.", "{n} (of {town}) showed {doc} {i} at ten.", "for {n} the {doc} {i}. {make} is slow.", "tel {p}", "tel {p}; {make}", "-- {n}", "{n}; {a}; tel {p}", "{n} stays at {a} and has {doc} {i}.", "stays at {a} and has {doc} {i}.", "{doc} {i}; tel. {p}.", "{doc} {i}, tel. {p}, mail {e}.", "{n} (from {town}) has {doc} {i} with her.", "A loan for {n} calls for {doc} {i}.", "{n}", "{n}", "mail {e} by {day}.", "{e} by noon.", "{n}: {doc} {i}", "Interview with {n}: part {d1}",
]
_FR = [
    "Ma voisine {n} élève des abeilles.", "Merci à {n} pour le gâteau.", "{n} a raté son train.", "Mme {n} enseigne le piano.", "M. {n} est absent.", "Selon {n}, il va pleuvoir.", "D'après {n}, tout va bien.", "Photo : {n}", "Bonjour {n}, ça va ?", "Signé {n}", "Répondez à {e}.", "Courriel : {e}", "Mon adresse {e} ne marche plus.", "Joindre {n} ({e}) ou {p}.",
    "Tél. {p}", "Appelez le {p} ce soir.", "Le {p} répond la nuit.", "Portable {p}, demandez {n}.", "Passeport {i} périmé.", "Numéro de sécurité sociale {i}", "{n} est titulaire du permis {i}.", "Sa carte {i} est perdue.", "{n} a montré le document {i}.", "Colis pour {n}, {fa}.", "Nous habitons {fa} depuis peu.", "{fa}", "Adresse : {fa}", "Retour au {fa}, merci.", "{n} loue une chambre, {fa}.", "chez {n}, {fa}.", "On écrit à {e} ou on appelle le {p}.", "{n} vit à {town}.", "Selon {n}, {make} va mieux.", "Pour {n}, {make} suffit.", "D'après {n}, {make} dort encore.", "{n} apporte la carte {i}.", "{e} ou au {p}.", "voir {n} à {e} ou au {p}. {make} dort.", "ou au {p}", "au {p}.", "{n} donne le numéro {i}.", "{n} tend le passeport {i}.", "{n} cite le permis {i}.", "à {e} ou au {p}.", "au {p} avant midi.", "{n}, au {p}", "Voyez {n}, {fa}, ou {e}.", "Écrivez à {n} : {e}",
]
_DE = [
    "Meine Nachbarin {n} hält Bienen.", "Danke an {n} für den Kuchen.", "{n} hat den Bus verpasst.", "Frau {n} gibt Klavierstunden.", "Herr {n} fehlt heute.", "Laut {n} regnet es bald.", "Nach Angaben von {n} stimmt alles.", "Foto: {n}", "Guten Tag {n}, wie geht es?", "Gezeichnet {n}", "Antwort an {e}.", "E-Mail: {e}", "Mein Postfach {e} ist tot.", "Fragen an {n} ({e}) oder {p}.",
    "Tel. {p}", "Ruf abends {p} an.", "Unter {p} meldet sich nachts jemand.", "Handy {p}, bitte {n} verlangen.", "Pass {i} ist abgelaufen.", "Versicherungsnummer {i}", "{n} besitzt den Führerschein {i}.", "Seine Karte {i} ging verloren.", "{n} zeigte Ausweis {i}.", "{n} nannte die Nummer {i}.", "Paket für {n}, {da}.", "Wir wohnen jetzt {da}.", "{da}", "Anschrift: {da}", "Zurück an {da}, danke.", "{n} mietet ein Zimmer in der {da}.", "an {n}, {da}.", "Schreib an {e} oder ruf {p} an.", "{n} wohnt in {town}.", "Erreichbar: {p}.", "Laut {n} schläft {make} noch.", "Für {n} reicht {make}.", "Wie {n} meint, ist {make} träge.", "{n} gab Ausweis {i} ab.", "{n} gab Pass {i} ab.", "{n} wies Ausweis {i} vor.", "{n} wies Pass {i} vor.", "{n} wies Rentennummer {i} vor.", "{n} wies Steuernummer {i} vor.", "{n} wies {i} vor.", "{n} gab Rentennummer {i} an.", "{n} gab Steuernummer {i} an.", "{n} hat Nummer {i}.", "an {n} ({e}, {p})", "bei {n}, {da}.", "{n} unter {e}", "Lieferung: {da}", "telefonisch {p}.",
]
_ES = [
    "Mi vecina {n} cría abejas.", "Gracias a {n} por la tarta.", "{n} perdió el autobús.", "La señora {n} da clases.", "El señor {n} no vino.", "Según {n}, va a llover.", "Para {n} todo va bien.", "Foto: {n}", "Hola {n}, ¿qué tal?", "Firmado, {n}", "Responda a {e}.", "Correo: {e}", "Mi buzón {e} ya no funciona.", "Consultas a {n} ({e}) o al {p}.",
    "Tel. {p}", "Llame al {p} esta tarde.", "En el {p} contestan de noche.", "Móvil {p}, pregunte por {n}.", "Pasaporte {i} caducado.", "Número de afiliación {i}", "{n} tiene el carné {i}.", "Su tarjeta {i} se perdió.", "{n} enseñó el documento {i}.", "Paquete para {n}, {sa}.", "Ahora vivimos en {sa}.", "{sa}", "Dirección: {sa}", "Devolver a {sa}, gracias.", "{n} alquila un cuarto en {sa}.", "a {n}, {sa}.", "Escríbanos a {e} o bien al {p}.", "{n} vive en {town}.", "Según {n}, {make} va mejor.", "Para {n}, {make} basta.", "Como dice {n}, {make} duerme.", "{n} dio el permiso {i}.", "en {e} o al {p}.", "llame al {p}. {make} duerme.", "o al {p}", "{n} dio el pasaporte {i}.", "{n} trajo el documento {i}.", "{n} citó el número {i}.", "a {n} en {e} o al {p}.", "al {p}, de noche.", "{n}, {sa}, {p}", "Vea a {n} en {sa}.", "Guardia: {p}.",
]
_NONE = [
    "Invoice {d4}-{d2}-{d3} was paid twice.", "Parcel RX{d8}GB is delayed.", "See ISBN 978-{d1}-{d4}-{d4}-{d1}.", "Lat {d2}.{d4}, lon -{d1}.{d4}", "v{d1}.{d2}.{d1} fixes bug #{d4}", "Upgrade from {d1}.{d1}.{d2} to {d1}.{d2}.{d1}.", "ping 10.{d2}.{d1}.{d3} took {d2} ms", "from {d2}:{d2} to {d2}:{d2}", "On 20{d2}-0{d1}-1{d1} sales hit {d5}.", "The {d2}/{d2}/20{d2} issue cost ${d2}.{d2}.",
    "Sum: {d3},{d3}.{d2} euros", "Part no. {d3}-{d4}-{d2}", "Batch {d6} and batch {d7} were mixed.", "Model {Word}-{d4} sold {d5} units.", "SKU {d4}{d4}{d3}", "Serial {d4}-{d4}-{d4}", "@media (min-width: {d3}px)", "@decorator def run(x={d2}): return x @ w", "price @ {d2} each", "see {word}@{d1}.{d1} in the lockfile", "git clone git@{word}:{word}/{word}", "ssh root@{word} -p {d4}", "@{word} liked this", "x = {{{{ {word} }}}} + {d2}", "[[{Word}]] ({d4})", "{word}_{d2} = [{d3}, {d3}, {d2}]", "sha {word}{d3}ab{d2}f", "SELECT {word} FROM {word} WHERE id = {d5}",
    "{Word} Street Market opens at dawn.", "The {Word} Road Show had {d3} guests.", "{Word} {Word} beats {Word} {d1} to {d1}.", "{firm} hired {d3} people.", "{firm} and {firm} merged on {day}.", "{day} {d2} June in {town}", "{town} has {d5} inhabitants.", "A day in {town} costs {d2}.", "{make}, a tiny {word}, weighs {d3} grams.", "{make} Pro {d1} runs {make} faster.", "With {make} the {word} takes {d2} seconds.", "How {make} made {word}s cheap", "{make}: a {word} for {word}s", "The {word} and the {word}s of {make}", "Is {make} worth {d3} {word}s? {make} says so.", "Every {word} with {d2} {word}s needs {make}.", "{make} and {make} share {d3} {word}s.",
    "By the {word}, {d4} {word}s are old.", "“The {word} was late,” a guest said.", "Nobody knew that {make} would last {d4} days.", "The {word} (built {d4}) holds {d3} {word}s.", "Chapter {d1}: The {Word} of {Word}", "{Word}, {word}, {Word}", "{Word} and {word}s", "Old {Word} and New {Word} are rivals.", "North {Word} lies past the {word}.", "JavaScript, {Word} and {make}", "See {Word} {Word} for details.", "Which {word} has {d2} {word}s? (A) {d1} (B) {d2} (C) {d3}",
    "Install {make} now, then rest.", "Buy {make} before it sells out.", "Open {make} and count {d2} {word}s.", "Use {make} with care.", "Start {make} first.", "Try {make} instead.", "Set {make} to {d2}.", "Compare {make} with {make}.", "Keep {make} dry.", "Beside {make}, the {word} looks small.", "Next to {make} the {word} lost {d3} {word}s.", "Measured against {make}, {d2} is fine.", "For {make}, {d2} {word}s.", "Suppose {make} sinks.", "Let {Word} be {d1}. Take {Word} too.",
    "Der {Noun} hob {d3} {Noun} im {Noun} auf.", "{d2} {Noun} am {Noun} sind neu.", "Sie lag am {Noun}, bis {make} sie fand.", "{make} kaufte {d3} {Noun} im {Noun}.", "Der {Noun} wog {d2} {Noun} im {Noun} und {d3} {Noun} am {Noun}.", "{Word} number {d1}-{d3}-{d2} is gone.", "The {word} has number {d1}-{d3}-{d2} or {d3}-{d4}.", "Prices of {Word} {Word} Foods rose {d3} times.", "Sheet {d3}/{d2} of {Word} {Word} {Word} lists {d3} {word}s.", "{Word} {Word} Press prints {d3} {word}s.", "{d3}/{d2} of {Word} {Word} Foods: {d2} {word}s.", "number {d1}-{d3}-{d2} of {Word} {Word} Tools",
    "Ende {Monat} kam der {Noun}.", "Anfang {Monat} fiel der {Noun} um {d2}.", "Am {Tag} kam ein {Noun}.", "Am {Tag} hob {make} {d3} {Noun}.", "Im {Monat} ruht die {Noun}.", "Am Abend zog der {Noun} von {Noun} {d2} {Noun}.", "Seit {Monat} hebt der {Noun} {d2} {Noun} auf.", "Bis {Tag} fand {make} {d2} {Noun}.", "Ist der {Noun} {d3} {Noun} wert?", "Der {Noun} zog {d2} {Noun} vor den {Noun}.", "Im Herbst und am {Tag} fehlte {make}.", "Order {d1}-{d3}-{d2} is late.", "Order no. {d3}-{d1}-{d2} under {XX}{d6}", "List {d3}/{d2} of {firm} has {d3} rows.", "{firm} priced {d3} {word}s.",
    "Shipped under code {XX}{d6}.", "Ticket {XX}-{d4} and code {XX}{d5} are void.", "Voucher {XX}{d4}{XX} has no value.", "A team from {town} won.", "The prize from {town} on {Word} Street", "{town} and {town} are twins.", "People of {town} like {make}.", "CLOSE THE {WORD} AND THE {WORD}, PLEASE", "{WORD} AND {WORD}: WHICH {WORD} HAS {d2} {WORD}S?", "THE {WORD} OF A {WORD} {WORD} FALLS {d3} TIMES", "BUY {WORD} {WORD} NOW", "{make}, {make} and {make}", "{make}, {word} of the year, fell.", "Here is {make}; there, {make} waits.", "Now {make} sells {d3} {word}s.", "Before the {word}, {make} sold {word}s.", "Dear {word} owners, {make} is back.",
    "for k in range({d3}): {word}[k] += {d2}", "if ({word} > {d4}) return {word};", "{d2} {word}s and {d3} {word}s in {d2} rows", "About {d4} {word}s left the {word} by {d2}:{d2}.", "Line {d3}: {word} not found",
    "Un {word} de {d3} pages coûte {d2} euros.", "Le {word} de {town} garde {d4} {word}s.", "Selon le {word}, {make} va mieux.", "{make} : un {word} rare", "Comment {make} range les {word}s", "La version {d2} de {make} est lente.", "Avec {make}, {d3} {word}s suffisent, dit le {word}.", "L'été, {make} perdait {d3} {word}s ; puis le {word} en sauvait un.", "Sans le {word}, {make} et {make} dorment.", "Commande {d3}-{d4} expédiée", "Chaque {word} vaut {d2} {word}s, mais pas {make}.",
    "Der {Noun} und die {Noun} kosten {d3} Euro.", "Im {Noun} von {town} stehen {d4} {Noun}.", "Laut {Noun} geht es {make} besser.", "{make}: ein {Noun} für {Noun}", "Wie {make} die {Noun} sortiert", "Fassung {d2} von {make} ist langsam.", "Mit {make} reichen {d3} {Noun}, sagt der {Noun}.", "Ohne {Noun} schlafen {make} und {make}.", "Auftrag {d3}-{d4} ist fertig", "Nach {d2} {Noun} kam der {Noun}, und {make} {Noun} wuchs.", "Wer {Noun} mag, der weiß, dass {make} {Noun} braucht.", "Neue {Noun} und alte {Noun} am {Noun}", "Jeder {Noun} bis {d4} gilt; {make} {d1} zählt {Noun}.",
    "Un {word} de {d3} hojas cuesta {d2} euros.", "El {word} de {town} guarda {d4} {word}s.", "Según el {word}, {make} va mejor.", "{make}: un {word} raro", "Cómo {make} ordena los {word}s", "La edición {d2} de {make} es lenta.", "Con {make} bastan {d3} {word}s, dice el {word}.", "Sin el {word}, {make} y {make} duermen.", "Pedido {d3}-{d4} enviado", "Cada {word} vale {d2} {word}s, pero no {make}.", "¿Cuánto cuesta {make} en {town}?", "y {make} contó {d3} {word}s",
]
_WORDS = "spoon kettle ladder pillow carpet wagon feather button basket hammer saddle candle magnet ribbon blanket teapot trumpet drawer lemon badger otter beetle maple granite cotton rafter gable cellar attic porch stove anvil bellows chisel lathe plough sickle thimble needle".split()
_DNOUNS = "Löffel Leiter Kissen Teppich Wagen Kiesel Feder Knopf Korb Hammer Sattel Kerze Magnet Decke Trompete Schublade Zitrone Nuss Dachs Käfer Weide Ahorn Marmor Kupfer Samt Wolle Giebel Veranda Amboss Meißel Pflug Sichel Nadel Fässer Gabeln Stühle Dosen Zäune".split()
_TOWNS = "Brackwell|Upper Thornby|East Quillham|Fenstead|Maplewick|Rosshaven|Grünau|Oberlinden|Steinfurt am Berg|Hohenrode|Beaurivage|Mont-Clair|Saint-Aubrac|Villefleur|Campoverde|Torre Alta|Puebla del Monte|Riofrío|Drumlow|Penwith".split("|")
_STREETS = "Walnut Street|Thimble Lane|Foundry Road|Orchard Avenue|Bishop's Row|Cobbler Close|Windmill Hill|Juniper Drive|Saddler St.|Granite Rd|Lantern Ct.|Beacon Ave|Nettle Blvd|Weaver Terrace|Linden Sq.|Chapel Walk|Old Mint Rd.|North Pier Way|Barley Crescent|Duke Place".split("|")
_DSTREETS = "Kupfergasse|Lerchenstraße|Ahornweg|Turmstraße|Am Brunnen|Rosenallee|Wiesenplatz|Im Winkel|Drosselstieg|Hufnagelstraße|An der Linde|Zum Anger".split("|")
_FSTREETS = "rue des Lilas|allée des Cerisiers|avenue du Moulin|place de l'Horloge|chemin du Lavoir|quai des Brumes|boulevard Carnot|impasse du Puits|route de Beaune|cours Lafitte|rue Pasteur|passage Vendôme".split("|")
_SSTREETS = "Calle de la Fuente|Avenida del Olivo|Plaza Nueva|Calle Cervantes|Paseo del Prado Viejo|Camino de las Eras|Calle del Pozo|Pasaje Aurora|Travesía de la Cruz|Plaza del Carmen".split("|")
_FIRMS = "Birch & Sons|Norwell Partners|Kite Brothers|Amber Textiles|Pinecone Software|Lakeview Dairy|Grand Union Bakers|Silver Fox Films|Oak Tree Insurance|Red Kettle Coffee".split("|")
_SURNAMES = "Lee Kim Fox Rey Roy Liu Vos Kos Dub Bák Šír Abbott Ackermann Alvarez Baker Barreto Bauer Becker Bennett Blanchard Bouvier Brandt Carter Castillo Chevalier Cohen Cooper Delacroix Dietrich Dominguez Duval Eriksson Faber Fischer Fontaine Foster Fuentes Garnier Gomez Graham Gruber Hartmann Herrera Hoffmann Hughes Iglesias Jensen Kovacs Krüger Lambert Larsen Lefebvre Lindqvist Lorenz Marchand Mendez Mercier Morris Müller Navarro Neumann Nowak Okafor Olsen Ortega Parker Petrov Pfeiffer Quinn Ramirez Renard Ritter Romero Rossi Roussel Sanders Schäfer Schneider Serrano Silva Stewart Suarez Tanaka Thompson Turner Ufer Vidal Vogel Wagner Walker Weber Wright Yilmaz Zapata Zimmermann".split()
_DOCS = "passport|national ID|social number|social security number|tax number|tax ID|permit|residence permit|ID card|ID|insurance number|licence|driving licence|passport number|identity card|national insurance number".split("|")
_ENDINGS = "ix os ify ado ino era una exo ium ora ible ario umo esta".split()


def _invented(r: random.Random, parts: int) -> str:
    """A word no dictionary has, of consonant, vowel and at times a closing consonant."""
    return "".join(r.choice("bcdfghjklmnprstvwyz") + r.choice("aeiou") + r.choice(("", "", "l", "n", "r", "s", "t", "b", "k", "m")) for _ in range(parts)).capitalize()


def _surname(r: random.Random) -> str:
    return r.choice(_SURNAMES) if r.random() < 0.35 else _invented(r, r.choice((2, 3, 3, 4)))


def make(r: random.Random) -> str:
    """A product's name."""
    return _invented(r, r.choice((2, 2, 3))) + r.choice((*_ENDINGS, "", "", " 2", " 3", " Lite", " Mini", "soft", "ly", "kit"))


def person(r: random.Random) -> str:
    given = r.choice(GIVEN).capitalize() if r.random() < 0.85 else _surname(r)[:7]
    last = _surname(r) + ("-" + _surname(r) if r.random() < 0.2 else "")
    k = r.random()
    if k < 0.5:
        return f"{given} {last}"
    if k < 0.54:
        return f"{given} {r.choice(('de', 'van', 'von', 'de la', 'del', 'di', 'van der'))} {last}"
    if k < 0.57:
        return f"{given} {last}".upper()
    if k < 0.73:
        return f"{last}, {given}"
    if k < 0.83:
        return f"{given} {r.choice('ABCDEFGHJKLMNOPRSTVW')}. {last}"
    if k < 0.92:
        return f"{given[0]}. {last}"
    if k < 0.95:
        return f"{given[0]}. {r.choice('ABCDEFGHJKLMNOPRSTVW')}. {last}"
    return f"{last}, {given[0]}."


def mailbox(r: random.Random) -> str:
    user = r.choice((f"{r.choice(GIVEN)}.{_surname(r).lower()}", f"{r.choice('abcdefghjklmnoprstvw')}{_surname(r).lower()}", f"{_surname(r).lower()}_{r.randint(0, 99):02d}", f"{r.choice(GIVEN)}{r.randint(1, 999)}", f"{r.choice(GIVEN)}+{r.choice(_WORDS)}", f"{r.choice(GIVEN)}-{_surname(r).lower()}"))
    name = r.choice(_WORDS)
    host = r.choice((f"{name}.net", f"{name}-{r.choice(_WORDS)}.example", f"{name}.co.uk", f"mx.{name}.de", f"{name}.fr", f"{name}.es", f"post.{name}.org", f"{name}box.com", f"{name}.test", f"{name}.mail.invalid"))
    k = r.random()
    if k < 0.55:
        m = f"{user}@{host}"
    elif k < 0.68:
        m = f"{user} [at] {host.replace('.', ' [dot] ')}"
    elif k < 0.76:
        m = f"{user}(at){host}"
    elif k < 0.84:
        m = f"{user} (at) {host.replace('.', ' (dot) ')}"
    else:
        m = f"{user} @ {host}"
    return m.upper() if k < 0.5 and r.random() < 0.2 else m


#: National and international ways to write telephone numbers, and numbers of documents: # is a digit, * a letter.
PHONES = (
    "+44 20 #### ####|020 #### ####|07### ######|+44 7### ######|01### ######|+1 ### ### ####|(###) ###-####|###.###.####|###-###-####|### ### ####|1-###-###-#### ext. ##|1-###-###-####|+1##########|(###) ###-#### x###|###-###-#### ext. ###|"
    "+33 # ## ## ## ##|0# ## ## ## ##|0# ## ## ## ##|0# ## ## ## ##|0#.##.##.##.##|0#.##.##.##.##|0#########|+33#########|0# ## ## ## ## poste ##|+49 ## ########|+49 ## ##### ###|0## ########|0##/#######|0##/########|0049 (##) #####-###|0## #### ####|0## ####-##|0## ####-## Durchwahl ##|0### #######|+49 ### #######|"
    "+34 ### ### ###|### ### ###|### ## ## ##|###-##-##-##|#########|9## ### ###|(0034) ### ## ## ##|+34#########"
).split("|")
DOCUMENTS = (
    "###-##-####|### ## ####|#########|*########|*#######|*#######|**######|*# ######|** ## ## ## *|** ## ## ## *|** ## ## ## *|**######*|## ###### * ###|########*###|# ## ## ## ### ### ##|#############|########-*|########*|*-#######-*|*#######*|*#######|##/###/#####|###/####/####|## ### ### ###|*##*##*##|*#**#*#*#|*##**###*|##-#######|#### #### ####|*###-####-####|** #######|*-#######"
).split("|")


def filled(r: random.Random, pattern: str) -> str:
    return "".join(r.choice("0123456789") if c == "#" else r.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "*" else c for c in pattern)


def phone(r: random.Random) -> str:
    return filled(r, r.choice(PHONES))


def document(r: random.Random) -> str:
    return filled(r, r.choice(DOCUMENTS))


def address(r: random.Random, lang: str) -> str:
    n, code, town = r.choice((str(r.randint(1, 320)), str(r.randint(1, 99)))), f"{r.randint(1000, 99999):05d}", r.choice(_TOWNS)
    if lang == "de":
        return f"{r.choice(_DSTREETS)} {n}{r.choice(('', '', '', 'a', 'b'))}" + r.choice((f", {code} {town}", f", {code} {town}", ""))
    if lang == "fr":
        return f"{n}{r.choice(('', '', '', ' bis'))}{r.choice((' ', ' ', ', '))}{r.choice(_FSTREETS)}" + r.choice((f", {code} {town}", f", {code} {town}", ""))
    if lang == "es":
        return f"{r.choice(_SSTREETS)}{r.choice((' ', ' ', ', '))}{n}" + r.choice((f", {code} {town}", f", {code} {town}", ""))
    s = f"{n} {r.choice(_STREETS)}"
    if r.random() < 0.35:
        s = f"{r.choice(('Flat', 'Flat', 'Apt', 'Apt.', 'Unit', 'Suite'))} {r.randint(1, 60)}, {s}"
    return s + r.choice(("", "", f", {town}", f", {town}", f", {town} {code}", f", {town}, {code}"))


_KIND = {"n": "person_name", "e": "email", "p": "phone", "i": "id_number", "a": "street_address", "da": "street_address", "fa": "street_address", "sa": "street_address"}


def _filler(r: random.Random, k: str) -> str:
    if k == "make":
        return make(r)
    if k[1:].isdigit():
        return str(r.randint(10 ** (int(k[1]) - 1), 10 ** int(k[1]) - 1))
    if k == "word":
        return r.choice(_WORDS) if r.random() < 0.6 else _invented(r, r.choice((2, 3))).lower()
    if k == "Word":
        return r.choice(_WORDS).capitalize() if r.random() < 0.6 else _invented(r, r.choice((2, 3)))
    if k == "WORD":
        return (r.choice(_WORDS) if r.random() < 0.5 else _invented(r, r.choice((2, 3)))).upper()
    if k in ("Monat", "Tag"):
        return r.choice("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split() if k == "Monat" else "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Wochenende".split())
    if k == "XX":
        return "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(2))
    if k == "Noun":
        return r.choice(_DNOUNS) if r.random() < 0.6 else _invented(r, r.choice((2, 3)))
    return r.choice({"town": _TOWNS, "firm": _FIRMS, "doc": _DOCS, "day": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()}[k])


def _sentence(r: random.Random, template: str) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans = "", []
    for part in re.split(r"(\{\{\{\{ ?|\}\}\}\}|\{\w+\})", template):
        k = part[1:-1]
        if part.startswith("{{{{"):
            text += "{{" + part[4:]
        elif part == "}}}}":
            text += "}}"
        elif part[:1] != "{":
            text += part
        elif k in _KIND:
            v = {"n": person, "e": mailbox, "p": phone, "i": document}[k](r) if k in "nepi" else address(r, {"a": "en", "da": "de", "fa": "fr", "sa": "es"}[k])
            spans.append((len(text), len(text) + len(v), _KIND[k]))
            text += v
        else:
            text += _filler(r, k)
    return text, spans


def labelled_sentences(rows: int = ROWS, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(sentence, [(start, end, kind)]), the same for the same seed."""
    r = random.Random(seed)
    out = []
    for _ in range(rows):
        group = r.random()
        t = r.choice(_EN if group < 0.28 else _FR if group < 0.35 else _DE if group < 0.42 else _ES if group < 0.49 else _NONE)
        text, spans = _sentence(r, t)
        while r.random() < 0.25 and text[-1:] in ".!?":  # sentences follow one another on a line
            text += " " + _sentence(r, r.choice(_NONE))[0]
        out.append((text, spans))
    return out
