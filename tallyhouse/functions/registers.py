"""Cleaning of the public registers, and protection of their personal fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.dates import format_legacy_date
from tallyhouse.operators.filters import map_values

# Birth dates with known typing errors.
DATE_FIXES = {
    "3010196": "30101960", "3010179": "30101979", "2801 966": "28011966", "29021954": "28021954", "29021947": "28021947",
}


def parse_ptbr_number(col: Column) -> Column:
    """``1.573.345,98`` to 1573345.98; null when it is no number."""
    digits = F.translate(F.translate(F.regexp_replace(col, r"\s+", ""), ".", ""), ",", ".")
    return digits.try_cast("double")


def pad_document(col: Column, size: int = 12) -> Column:
    """Document number without spaces, zeros in front; longer ones are kept."""
    plain = F.regexp_replace(col, r"\s+", "")
    return F.when(F.length(plain) < size, F.lpad(plain, size, "0")).otherwise(plain)


def last_path_part(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def clean_candidates(df: DataFrame, document_fixes: Mapping[str, str] | None = None) -> DataFrame:
    """Birth date, education, voter number, document and office of the candidates."""
    education = F.regexp_replace(
        F.regexp_replace("DS_GRAU_INSTRUCAO", "^FUNDAMENTAL", "ENSINO FUNDAMENTAL"), "^MÉDIO", "ENSINO MÉDIO"
    )
    document = F.col("NR_CPF_CANDIDATO")
    return df.withColumns(
        {
            "DT_NASCIMENTO": format_legacy_date(map_values(F.col("DT_NASCIMENTO"), DATE_FIXES)),
            "DS_GRAU_INSTRUCAO": education,
            "NR_TITULO_ELEITORAL_CANDIDATO": pad_document(F.col("NR_TITULO_ELEITORAL_CANDIDATO")),
            "NR_CPF_CANDIDATO": map_values(document, document_fixes) if document_fixes else document,
            "DS_CARGO": F.replace(F.col("DS_CARGO"), F.lit("º SUPLENTE SENADOR"), F.lit("º SUPLENTE")),
        }
    )


def clean_assets(df: DataFrame) -> DataFrame:
    """Asset values: decimal comma to point, sign dropped (negatives are typing errors)."""
    value = F.translate("VR_BEM_CANDIDATO", ",", ".").cast("double")
    return df.withColumn("VR_BEM_CANDIDATO", F.abs(value))


def clean_votes(df: DataFrame, wrong_unit_year: int = 2006) -> DataFrame:
    """Unit code of the year where it is wrong taken from the state; office in capitals."""
    unit = F.when(F.col("ANO_ELEICAO") == wrong_unit_year, F.col("SG_UF")).otherwise(F.col("SG_UE"))
    return df.withColumns({"SG_UE": unit, "DS_CARGO": F.upper("DS_CARGO")})


def clean_voters(df: DataFrame) -> DataFrame:
    """Age range as ``Inválido``/capitalised text, sex and education with their accents."""
    age = F.regexp_replace(F.lower("FAIXA_ETARIA"), "inválida", "Inválido")
    return df.withColumns(
        {
            "FAIXA_ETARIA": F.concat(F.upper(F.substring(age, 1, 1)), F.substr(age, F.lit(2))),
            "SEXO": F.regexp_replace("SEXO", "NAO INFORMADO", "NÃO INFORMADO"),
            "GRAU_DE_ESCOLARIDADE": F.regexp_replace(
                F.regexp_replace("GRAU_DE_ESCOLARIDADE", "NAO INFORMADO", "NÃO INFORMADO"), "LE E ESCREVE", "LÊ E ESCREVE"
            ),
        }
    )


def vote_share(votes: Column, voters: Column) -> Column:
    """Votes per hundred million voters of the unit."""
    return F.try_divide(votes.cast("double") * 1e8, voters.cast("double"))


def account_features(df: DataFrame, created: str, name: str, description: str, at: str) -> DataFrame:
    """Age of an account in days at ``at``, and length of the first run of 2 to 5 digits in two texts."""
    days = F.timestamp_diff("MICROSECOND", F.col(created), F.lit(at).cast("timestamp_ntz")) / F.lit(86_400_000_000.0)
    run = lambda c: F.coalesce(F.length(F.regexp_extract(c, r"(?U)\d{2,5}", 0)), F.lit(0))
    return df.withColumns({"days_created": days, "digits_name": run(name), "digits_desc": run(description)})


def encrypt_cols(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Listed columns that exist become base64 AES-GCM texts; equal values get different texts.

    Pass the key from a secret store. It becomes a literal of the plan, so keep plans of
    such jobs out of shared logs (``spark.sql.redaction.string.regex`` can mask it).
    """
    have = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.base64(F.aes_encrypt(F.col(c).cast("string"), F.lit(key), F.lit("GCM"))) for c in have})


def decrypt_cols(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    have = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.aes_decrypt(F.unbase64(F.col(c)), F.lit(key), F.lit("GCM")).cast("string") for c in have})
