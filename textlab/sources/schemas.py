"""Declared schemas of the landed inputs; nothing is inferred."""

from __future__ import annotations

MEMBERS = (
    "id int, firstLastName string, lastFirstName string, accusativeName string, "
    "genitiveName string, email string, club string, birthDate string, birthLocation string, "
    "educationLevel string, profession string, districtNum int, districtName string, "
    "voivodeship string, numberOfVotes int, active boolean, inactiveCause string, waiverDesc string"
)
CLUBS = "id string, name string, membersCount int, email string, fax string, phone string"
PROFILE = (
    "mp_num int, url string, name string, staz_parlamentarny string, ukonczona_szkola string, "
    "error string"
)
# ``from`` may arrive as one number or as a list; see readers.author_list.
WRITTEN_DETAILS = (
    "num int, title string, `from` string, `to` array<string>, sentDate date, receiptDate date, "
    "replies array<struct<key: string, attachments: array<struct<URL: string, name: string>>>>"
)
DAY_INDEX = (
    "proceedingNum int, date string, statements array<struct<num: int, memberID: int, "
    "name: string, function: string, unspoken: boolean, startDateTime: string, "
    "endDateTime: string, rapporteur: boolean, secretary: boolean>>"
)
STATEMENT_INDEX = (
    "term int, proceedingNum int, date string, statementNum int, memberID int, name string, "
    "function string, startDateTime string, endDateTime string, rapporteur boolean, "
    "secretary boolean, unspoken boolean"
)
LEXICON = "word string, pos string, emo1 string, emo2 string, emo3 string, val double"
CITY_CACHE = "miejsceUr string, miejsceUrLan double, miejsceUrLon double"
ROSTER = (
    "id int, imieNazwisko string, klub string, dataUr string, wiek int, miejsceUr string, "
    "plec string, ukonczonaSzkola string, wyksztalcenie string, najwyzszyStopienNaukowy string, "
    "liczbaStudiowPodyplomowych int, zawod string, nrOkreguWyborczego int, okregWyborczy string, "
    "wojewodztwoOkreguWyborczego string, liczbaGlosow int, stazParlamentarny string, "
    "ktoraKadencja int, czyAktywny string, powodNieaktywnosci string, "
    "nieaktywnoscKomentarz string, nieaktywnoscKategoria string"
)
