"""Table schemas of the corpus, as Spark DDL."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "statute_text": "legitext string, titre string, titre_long string, nature string, etat string, "
                    "date_debut string, date_fin string, date_publi string, num_jorf string, nor string",
    "statute_version": "legiarti string, legitext string, num string, titre_text string, etat string, "
                       "date_debut string, date_fin string, texte string, nota string",
    "gazette_text": "jorftext string, titre string, titre_long string, nature string, date_publi string, "
                    "date_signature string, num_jorf string, nor string, ministere string, texte string, nota string",
    "decision": "id string, ecli string, juridiction string, formation string, date string, numero string, "
                "solution string, nature string, president string, rapporteur string, avocat_general string, "
                "avocats string, titre string, sommaire string, texte string",
    "decision_enriched": "id string, nature string, titre string, date string, juridiction string, "
                         "solution string, numero string, formation string, ecli string, president string, "
                         "avocats string, text string, sommaire string, abstrats string, resume string, "
                         "renvois string, rapporteur string, commissaire_gvt string, type_rec string, "
                         "publi_recueil string, publi_bull string, nature_qualifiee string, saisines string, "
                         "loi_def string, liens_textes string",
    "agreement": "id string, idcc string, titre string, nature string, etat string, date_publi string, "
                 "date_debut string, date_fin string, texte string",
    "deliberation": "id string, numero string, titre string, date string, formation string, texte string",
    "echr_decision": "itemid string, docname string, ecli string, date string, doctype string, "
                     "article string, conclusion string, importance string, respondent string, "
                     "originating_body string, text string",
    "cjeu_decision": "celex string, ecli string, date string, type string, title string, text string",
    "ce_decision": "ariane_id string, ariane_num int, text string, fetched_at string",
    "admin_opendata": "id string, juridiction_code string, juridiction_name string, date string, "
                      "numero_dossier string, ecli string, formation string, type_decision string, "
                      "publication_code string, last_modified string, texte string, fetched_at string",
    "code_article": "article_id string, code_cid string, code_titre_court string, num string, titre string, "
                    "texte string, etat string, date_debut string, date_fin string",
    "thes_concept": "source string, code string, label string, parent_code string, depth int, "
                    "scope string, freq long",
    "thes_label": "source string, code string, label string, label_normalized string, label_type string",
    "thes_relation": "source string, src_code string, dst_code string, rel_type string",
    "directory_entry": "id string, type string, nom string, mails array<string>, tel string, site string, "
                       "source string, source_url string, source_label string, contact_extra string, "
                       "raw_pivot string, hierarchie string, adresse_postale string",
}

# Identifier, date and docket column of each collection; text search and enumeration use this
# one map instead of assuming that every table has `date` and `numero`.
COLLECTION_COLUMNS: dict[str, dict[str, str | None]] = {
    "statute_version": {"id": "legiarti", "date": "date_debut", "numero": "num"},
    "gazette_text": {"id": "jorftext", "date": "date_publi", "numero": "num_jorf"},
    "decision": {"id": "id", "date": "date", "numero": "numero"},
    "decision_enriched": {"id": "id", "date": "date", "numero": "numero"},
    "agreement": {"id": "id", "date": "date_publi", "numero": "idcc"},
    "deliberation": {"id": "id", "date": "date", "numero": "numero"},
    "echr_decision": {"id": "itemid", "date": "date", "numero": "appno"},
    "cjeu_decision": {"id": "celex", "date": "date", "numero": "affaire_num"},
    "ce_decision": {"id": "ariane_id", "date": None, "numero": "ariane_num"},
    "admin_opendata": {"id": "id", "date": "date", "numero": "numero_dossier"},
}

# Columns that are indexed for full-text search, in field order.
TEXT_COLUMNS: dict[str, list[str]] = {
    "statute_version": ["titre_text", "num", "texte"],
    "gazette_text": ["titre", "nature", "ministere", "texte", "nota"],
    "decision": ["juridiction", "numero", "titre", "sommaire", "texte"],
    "decision_enriched": ["titre", "juridiction", "solution", "numero", "formation", "text", "numero_rg_norm"],
    "agreement": ["idcc", "titre", "texte"],
    "deliberation": ["numero", "titre", "formation", "texte"],
    "echr_decision": ["docname", "article", "conclusion", "text", "appno_norm"],
    "cjeu_decision": ["ecli", "title", "text", "affaire_num_norm"],
    "ce_decision": ["text"],
    "admin_opendata": ["juridiction_name", "numero_dossier", "texte"],
    "code_article": ["code_titre_court", "num", "titre", "texte"],
}
