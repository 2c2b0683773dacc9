"""Entity types, presets and lists that callers choose from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Labels and names of the entity types, in catalogue order; presets; never-redact lists.
ENTITY_TYPES = {
    "person": "Person",
    "organisation": "Organisation",
    "adresse": "Adresse",
    "ort": "Ort",
    "geburtsdatum": "Geburtsdatum",
    "datum": "Datum",
    "geldbetrag": "Geldbetrag",
    "telefonnummer": "Telefonnummer",
    "e-mail-adresse": "E-Mail-Adresse",
    "iban": "IBAN",
    "ahv-nummer": "AHV-Nummer",
    "aktenzeichen": "Aktenzeichen",
    "dienstkennung": "Dienstkennung",
    "seriennummer": "Seriennummer",
    "ip-adresse": "IP-Adresse",
    "mac-adresse": "MAC-Adresse",
    "kfz-kennzeichen": "Kontrollschild",
    "ausweisnummer": "Ausweisnummer",
    "versichertennummer": "Versichertennummer",
    "patientennummer": "Patientennummer",
    "uid-nummer": "UID-Nummer",
    "beruf": "Beruf",
    "nationalitaet": "Nationalität",
    "gesundheitsangabe": "Gesundheitsangabe",
    "url": "URL",
    "benutzername": "Benutzername",
    "plz": "PLZ",
}
#: What a detector is told about each type.
DESCRIPTIONS = {
    "person": "Vor- und Nachname eines Menschen, auch einzeln",
    "organisation": "Firma, Amt, Verein oder andere Körperschaft",
    "adresse": "Strasse mit Hausnummer, auch mit Postleitzahl und Ort",
    "ort": "Gemeinde, Kanton, Land oder andere Ortsangabe",
    "geburtsdatum": "Tag der Geburt eines Menschen",
    "datum": "Kalendertag, in Ziffern oder mit Monatsnamen",
    "geldbetrag": "Betrag mit Währung",
    "telefonnummer": "Festnetz- oder Mobilnummer, auch mit Landesvorwahl",
    "e-mail-adresse": "Adresse eines elektronischen Postfachs",
    "iban": "Internationale Kontonummer",
    "ahv-nummer": "Dreizehnstellige Sozialversicherungsnummer, beginnt mit 756",
    "aktenzeichen": "Zeichen eines Geschäfts oder Verfahrens",
    "dienstkennung": "Kennung einer Dienststelle oder eines Angehörigen davon",
    "seriennummer": "Nummer eines einzelnen Geräts",
    "ip-adresse": "Netzadresse nach IPv4 oder IPv6",
    "mac-adresse": "Geräteadresse aus sechs Paaren von Hexziffern",
    "kfz-kennzeichen": "Nummer eines Fahrzeugschilds",
    "ausweisnummer": "Nummer von Pass oder Identitätskarte",
    "versichertennummer": "Nummer bei einer Versicherung",
    "patientennummer": "Nummer bei einem Spital oder einer Praxis",
    "uid-nummer": "Kennnummer eines Unternehmens, beginnt mit CHE",
    "beruf": "Beruf oder Funktion eines Menschen",
    "nationalitaet": "Staatsangehörigkeit eines Menschen",
    "gesundheitsangabe": "Krankheit, Befund, Behandlung oder Arznei",
    "url": "Adresse einer Seite im Netz",
    "benutzername": "Name eines Kontos",
    "plz": "Postleitzahl ohne Ort",
}
PRESETS = {
    "default": ["person", "ort"],
    "legal": ["person", "ort", "plz", "organisation", "datum", "telefonnummer"],
    "full": list(ENTITY_TYPES),
}
BLACKLISTS = {"default": ["acme", "widget"], "legal": ["court", "plaintiff", "defendant", "judge"]}
REPEATING_LABELS = ("person", "organisation", "adresse", "ort", "e-mail-adresse", "telefonnummer")


def entity_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, DESCRIPTIONS[k], i) for i, (k, v) in enumerate(ENTITY_TYPES.items())], "label string, name string, description string, ord int")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, label, i) for p, labels in PRESETS.items() for i, label in enumerate(labels)], "preset string, label string, ord int")


def blacklists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, w) for p, words in BLACKLISTS.items() for w in words], "preset string, word string")


def requested_types(spark: SparkSession, preset: str) -> DataFrame:
    """The preset's rows of the catalogue."""
    return entity_types(spark).join(presets(spark).where(f"preset = '{preset}'").select("label"), "label", "left_semi")


def filled(entity_types: list[str] | dict | None, blacklist: list[str] | None, preset: str = "default") -> tuple[list[str], list[str]]:
    """What a caller left empty is taken from the preset, each for itself."""
    return list(entity_types or PRESETS[preset]), list(blacklist or BLACKLISTS.get(preset, []))


def extended(base: list[str], *more: str) -> list[str]:
    """A preset's list with further entries, none twice."""
    return list(dict.fromkeys([*base, *more]))
