"""The star schema of the given tables, stage by stage."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweir import schemas
from creditweir.operators import dimensions, facts, scd2, silver
from creditweir.plans import given_tables as given
from creditweir.session import cut, small_table


class Star:
    """Lazily built layers over one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def bronze(self) -> DataFrame:
        return given.bronze_applications(self.spark, self.sf_dir)

    @cached_property
    def silver_rows(self) -> DataFrame:
        return silver.to_silver(self.bronze, F.lit(given.FIRST_SNAPSHOT))

    @cached_property
    def silver(self) -> DataFrame:
        """Silver as a written table: several gold tables are built from it."""
        return cut(self.silver_rows)

    @cached_property
    def silver_later(self) -> DataFrame:
        return given.second_snapshot(self.silver)

    @cached_property
    def incomes(self) -> DataFrame:
        return dimensions.income_bands(self.spark)

    @cached_property
    def utilisations(self) -> DataFrame:
        return dimensions.utilisation_bands(self.spark)

    @cached_property
    def profiles(self) -> DataFrame:
        return dimensions.delinquency_profiles(self.spark)

    @cached_property
    def no_borrowers(self) -> DataFrame:
        return small_table(self.spark, [], schemas.DIM_BORROWER)

    @cached_property
    def borrowers(self) -> DataFrame:
        """The dimension after the first load."""
        return scd2.merge_versions(self.no_borrowers, scd2.borrower_attributes(self.silver))

    @cached_property
    def borrowers_later(self) -> DataFrame:
        """The dimension after the second load."""
        return scd2.merge_versions(self.borrowers, scd2.borrower_attributes(self.silver_later))

    def fact_of(self, rows: DataFrame, borrowers: DataFrame) -> DataFrame:
        return facts.build_fact(rows, borrowers, self.incomes, self.utilisations, self.profiles)

    @cached_property
    def fact(self) -> DataFrame:
        return self.fact_of(self.silver, self.borrowers)

    @cached_property
    def fact_later(self) -> DataFrame:
        return self.fact_of(self.silver_later, self.borrowers_later)

    @cached_property
    def view(self) -> DataFrame:
        return facts.credit_view(self.fact, self.borrowers)

    @cached_property
    def stored_view(self) -> DataFrame:
        """The model view as a written table, for jobs that pass over it often."""
        return cut(self.view)
