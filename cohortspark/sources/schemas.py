"""Declared schemas of the tables an analysis reads."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "membership": "AnimalID string, AnimalRef int, MemberFrom date, MemberTo date, Colony string, ColonyLocation string",
    "animal": "AnimalID string, WildCaught int, Queen int, LitterRef int, RowRef int",
    "sex": "AnimalID string, Sex string",
    "weight": "AnimalID string, WeightDate date, Weight double, WeightType string",
    "birth": "AnimalID string, AnimalRef int, BirthDate date",
    "death": "AnimalID string, AnimalRef int, DeathDate date",
    "pairing": "AnimalID string, Colony string, PairingDate date",
    "colony": "Colony string, ColonyRef int, ColonyOrigin string, ColonyLocation string",
    "litter": "LitterRef int, MotherID string, BirthDate date, Exact int",
    "parentage": "LitterRef int, MotherID string, FatherID string",
    "experiment_subject": "AnimalID string, ExpName string, ExperimentStartDate date",
    "exported_sample": "SampleNumber int, SampleType string, Date_Exported date, Purpose string, DestinationLab string",
    "sample": "Colony string, AnimalID string, SampleType string, CollectionDate date, SampleID int, Label string, ExpName string",
    "brain": "AnimalID string, SacrificeDate date, BranUse string, BreedingStatus string, Training string",
    "scan_session": "ObsRef int, Colony string, ObsDate date, TotalScanNumber double",
    "scan_instant": "ObsRef int, AnimalID string, Behaviour string, BehaviourCount int",
    "scan_continuous": "ObsRef int, AnimalID string, PartnerID string, Behaviour string, BehaviourCount int",
    "focal_session": "ObsRef int, DataSource string, AnimalID string, Colony string, ObsDate date, ObservedDuration double, OutOfSight double, ExpName string",
    "focal_event": "ObsRef int, FocalBehavRef int, Behaviour string, BehaviourType string, Behav_Duration double, BehaviourCount int, Received string, Copulation_Direction string, Pass_Direction string, Pass_Location string",
    "focal_summary": "FocalRef int, DataSource string, BehaviourType string, Behaviour string, TotalDuration double, BehaviourCount int, ModifierClass1 string, ModifierClass2 string, ModifierValue1 int",
    "dyad": "DataSource string, FocalRef int, FocalDate date, StartTime string, EventTime string, Behaviour string, Colony string, AnimalID string, PartnerID string, ReceivedValue int, ModifierLabel2 string, ModifierLabel3 string, InteractionRef int, ExpName string",
    "behaviour_code": "CodeRef string, Label string, Value int, BehaviourRaw string, ReceivedValue int",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def names() -> list[str]:
    return list(_DDL)
