"""The label catalog: what kinds of sensitive data there are, each with a category and tags.

Fixed values: label ids, their categories and their tags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# category: labels, each with its tags after a colon
BUILT_IN = {
    "identity": "person_name:pii date_of_birth:pii government_id:pii tax_id:pii drivers_license:pii certificate_number:pii passport_number:pii national_insurance_number:pii vehicle_id:pii license_plate:pii signature:pii",
    "contact": "email_address:pii phone_number:pii fax_number:pii address:pii street_address:pii postal_code communications_content:pii",
    "geographic": "city:pii state country coordinates:pii precise_geolocation:pii geolocation_metadata:pii",
    "demographic": "age:pii gender:pii nationality:pii citizenship:pii language",
    "protected_characteristic": "ethnicity:pii religion:pii political_opinion:pii trade_union_membership:pii sexual_orientation:pii sex_life:pii",
    "financial": "payment_card:pci,pii card_security_code:pci,sad card_track_data:pci,sad pin_block:pci,sad card_expiry:pci bank_account:pii bank_routing iban:pii swift_code crypto_address:pii currency monetary_amount",
    "health": "medical_id:phi,pii insurance_id:phi,pii prescription_id:phi diagnosis:phi medication:phi health_narrative:phi",
    "biometric": "fingerprint:pii voiceprint:pii retina_scan:pii facial_geometry:pii genetic_data:pii face:pii",
    "judicial": "criminal_record:pii criminal_charge:pii court_case_number:pii judicial_narrative:pii",
    "credentials": "password:secret security_question_answer:secret api_key:secret auth_token:secret private_key:secret",
    "network": "url ip_address:pii mac_address:pii device_id:pii username:pii",
    "organization": "organization_name company_id department_name facility_name case_number internal_id occupation product logo",
    "contextual": "date_time handwriting barcode individual_date:pii event education_record:pii inference:pii unresolved",
}


class Catalog:
    """Label id -> (category, tags). An empty catalog keeps every label."""

    def __init__(self, labels: dict[str, tuple[str | None, tuple[str, ...]]] | None = None):
        self.labels = dict(labels or {})

    @classmethod
    def built_in(cls) -> Catalog:
        out = {}
        for category, names in BUILT_IN.items():
            for entry in names.split():
                label, _, tags = entry.partition(":")
                out[label] = (category, tuple(tags.split(",")) if tags else ())
        return cls(out)

    def with_label(self, label: str, category: str | None = None, tags: Iterable[str] = ()) -> Catalog:
        return Catalog({**self.labels, label: (category, tuple(tags))})

    def only(self, names: Iterable[str]) -> Catalog:
        return Catalog({n: self.labels.get(n, (None, ())) for n in names})

    def tagged(self, tag: str) -> list[str]:
        return [n for n, (_, tags) in self.labels.items() if tag in tags]

    def category(self, label: str) -> str | None:
        return self.labels.get(label, (None, ()))[0]

    def declares(self, label: str) -> bool:
        return not self.labels or label in self.labels

    def resolve(self, candidates: list[str]) -> str:
        """The first candidate that the catalog declares, else the first."""
        return next((c for c in candidates if self.declares(c)), candidates[0])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, c, list(t)) for n, (c, t) in self.labels.items()]
        return spark.createDataFrame(rows, "label string, category string, tags array<string>")
