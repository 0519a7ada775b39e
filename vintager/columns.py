"""Column roles shared by every operator.

An observation says: *entity* (in *group*) states *measure* for *target* date, as
of *published*. Operators only speak in these roles, so another table of the same
shape is served by passing another ``Columns``.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Columns:
    dataset: str = "dataset"
    group: str = "fuelType"
    entity: str = "nationalGridBmUnit"
    alias: str = "bmUnit"
    published: str = "publishTime"
    target: str = "forecastDate"
    measure: str = "outputUsable"
    collected: str = "collectedAt"

    @property
    def required(self) -> list[str]:
        return [
            self.dataset,
            self.group,
            self.entity,
            self.alias,
            self.published,
            self.target,
            self.measure,
            self.collected,
        ]

    @property
    def key(self) -> list[str]:
        """One stored row per entity, publication and target date."""
        return [self.entity, self.published, self.target]

    @property
    def entity_series(self) -> list[str]:
        return [self.entity, self.target]

    @property
    def group_series(self) -> list[str]:
        return [self.group, self.target]

    @property
    def total_series(self) -> list[str]:
        return [self.target]


DEFAULT = Columns()

# Names of the columns that revision operators add.
PREVIOUS_TIME = "previousPublishTime"
LATEST_TIME = "latestPublishTime"
PREVIOUS_MW = "previousAvailableMW"
LATEST_MW = "latestAvailableMW"
PREVIOUS_GROUP = "previousFuelType"
REVISION = "revisionMW"
ABS_REVISION = "absoluteRevisionMW"
DIRECTION = "revisionDirection"
GROUP_CHANGED = "fuelTypeChanged"
PAIR_DIRECTION = "changeDirection"
BECAME_UNAVAILABLE = "becameUnavailable"
RETURNED_AVAILABLE = "returnedAvailable"
AVAILABLE = "availableMW"

# Physical partition column of stored publications and history tables.
PUBLISH_DATE = "publish_date"
