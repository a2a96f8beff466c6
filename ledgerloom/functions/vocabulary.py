"""The words by which chunks of Portuguese liability policies are routed. They are plain parameters of operators.routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: fixed values: keywords of each profile and of the split stages
KEYWORDS = {
    "core": ["seguradora", "tomadora", "segurada", "numero da apolice", "vigencia", "moeda", "premio", "limite maximo", "limite agregado", "retroatividade", "prazo adicional", "ambito geografico", "jurisdicao", "base de cobertura", "franquia", "retencao", "limites e franquias", "processo susep", "versao", "territorio", "qualquer lugar do mundo", "leis do brasil", "base de reclamacoes"],
    "risk": ["coberturas", "cobertura", "side a", "side b", "side c", "entity coverage", "custos de defesa", "despesas de defesa", "investigacao", "sublimite", "bens e liberdade", "extensoes", "extensao", "exclusoes", "exclusao", "franquia", "retencao", "garantia a", "garantia b", "garantia basica", "bloqueio", "indisponibilidade", "custos de investigacao", "danos ambientais", "exclusao conduta", "reclamacoes e circunstancias anteriores"],
    "semantic": ["definicoes", "pessoa segurada", "administrador segurado", "reclamacao", "claim", "ato danoso", "ato de gestao", "perda", "subsidiaria", "controlada", "condicoes e clausulas", "aviso", "notificacao", "cooperacao", "separabilidade", "severability", "alteracao de controle", "mudanca de controle", "run-off", "run off", "prioridade de pagamentos", "priority of payments", "alocacao", "antecipacao", "consentimento para acordo", "ordem dos pagamentos", "adiantamentos de custos de defesa", "perda indenizavel"],
    "coverages_extensions": ["cobertura", "coberturas", "garantia", "garantia a", "garantia b", "extensao", "extensoes", "bens e liberdade", "bloqueio", "indisponibilidade", "investigacao", "custos de investigacao", "custos de defesa", "sublimite"],
    "exclusions": ["exclusao", "exclusoes", "conduta", "fraude", "desonestidade", "danos ambientais", "danos corporais", "danos materiais", "reclamacoes anteriores", "circunstancias anteriores", "litigio anterior", "segurado contra segurado", "servicos profissionais"],
    "definitions": ["definicoes", "glossario", "segurado", "pessoa segurada", "reclamacao", "ato danoso", "ato de gestao", "perda indenizavel", "perda", "custos de defesa", "despesas de defesa", "subsidiaria", "controlada"],
    "clauses": ["alocacao", "ordem dos pagamentos", "prioridade de pagamentos", "adiantamento", "custos de defesa", "aviso de sinistro", "notificacao", "separabilidade", "alteracao de controle", "run off", "consentimento para acordo", "cooperacao"],
}
#: fixed values: headings that lift a chunk of a short document
HEADINGS = {"core": ["especificacao", "limites e franquias"], "risk": ["2. coberturas", "3. extensoes", "4. exclusoes"], "semantic": ["1. definicoes", "5. condicoes e clausulas relevantes"]}
#: fixed values: phrases that name the sections of a long document
SECTIONS = {
    "core": ["clausula 3. objetivo do seguro", "clausula 10. vigencia", "clausula 25. limite e franquia", "clausula 34. lei aplicavel e foro", "clausula 36. ambito geografico de cobertura"],
    "risk": ["clausula 4. coberturas", "clausula 5. extensoes de cobertura", "clausula 7. exclusoes"],
    "semantic": ["clausula 15. aviso de sinistro", "clausula 21. alocacao", "clausula 22. prioridade de pagamento de perda", "clausula 39. definicoes"],
    "coverages_extensions": ["coberturas", "garantias", "extensoes de cobertura"],
    "exclusions": ["exclusoes", "riscos excluidos"],
}


def folded_words(words: list[str]) -> list[str]:
    """The words as a folded text holds them: letters and digits, each once."""
    return list(dict.fromkeys(" ".join("".join(c if c.isalnum() else " " for c in w).split()) for w in words))


def terms(spark: SparkSession, table: dict[str, list[str]]) -> DataFrame:
    """(profile, item, term) of a table of words."""
    return spark.createDataFrame([(p, w, w) for p, words in table.items() for w in folded_words(words)], "profile string, item string, term string")
