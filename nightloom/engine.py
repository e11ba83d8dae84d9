"""What users call: ingestion of a source into tables, datasets with folds, evaluation and reports."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightloom import schema
from nightloom.functions import dsp
from nightloom.operators import channels, gather, metrics, prototypes, scaling, sequences, splits
from nightloom.plans import models
from nightloom.sources import folds, sinks, store
from nightloom.training import loop, nets

#: Named preprocessors of an epoch's samples; more can be registered.
PREPROCESSORS: dict[str, Callable[[Column], Column]] = {
    "xsleepnet": lambda c: dsp.log_spectrogram_column(c, 100.0, 200, 100, 256),
    "xsleepnet_mouse": lambda c: dsp.log_spectrogram_column(c, 100.0, 200, 188, 256),
}
#: Named losses: (label, prediction) to a column that is averaged.
LOSSES: dict[str, Callable[[Column, Column], Column]] = {
    "cel": lambda y, p: metrics.cross_entropy(p, y),
    "reg": lambda y, p: metrics.huber(y, p),
    "mse": lambda y, p: (y - p) * (y - p),
}


def register_preprocessor(name: str, fn: Callable[[Column], Column]) -> None:
    PREPROCESSORS[name] = fn


def imported(spec: str) -> object:
    """What ``module:name`` names."""
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"{spec} is not of the form module:name")
    return getattr(importlib.import_module(module), name)


def register_loss(name: str, fn: Callable[[Column, Column], Column]) -> None:
    LOSSES[name] = fn


class DatasetSource(ABC):
    """A data set that can be ingested. Records that cannot be read leave no epochs, but keep their subject_id."""

    name: str
    #: A folder for what read() decodes, where ingest() names one; it goes when the tables are written.
    staging: str | None = None

    def staged(self, decoded: DataFrame) -> DataFrame:
        """What has been decoded, written once where there is a staging folder, so that later steps do not decode again."""
        if self.staging is None:
            return decoded
        decoded.write.mode("overwrite").parquet(self.staging)
        return decoded.sparkSession.read.schema(decoded.schema).parquet(self.staging)

    @abstractmethod
    def records(self, spark: SparkSession) -> DataFrame:
        """subject_id, record_id and whatever read() needs, in a fixed order."""

    @abstractmethod
    def read(self, spark: SparkSession, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(subject_id, epoch_idx, channel, samples) and (subject_id, epoch_idx, stage)."""

    def customise(self, subjects: DataFrame) -> DataFrame:
        return subjects

    def folds(self, subjects: DataFrame) -> DataFrame:
        """(subject_id, fold, split); by default a seeded random choice by subject."""
        spark = subjects.sparkSession
        # The ids are metadata, one a record: the draw is the same as numpy's on one machine, and as small.
        ids = [r[0] for r in subjects.select("subject_id").orderBy("subject_id").collect()]
        return spark.createDataFrame([(i, 0, s) for i, s in zip(ids, splits.random_split(len(ids)), strict=True)], "subject_id int, fold int, split string")


@dataclass
class Tables:
    """The tables of some data sets, read lazily from a folder; their raw epochs from a bundle (see compress()) where one is given."""

    spark: SparkSession
    path: str
    bundle: str | None = None

    @property
    def folds(self) -> DataFrame:
        """The folds as the last whole rewrite has left them."""
        return folds.current(self.spark, self.path)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("subjects", "epochs", "labels", "scaling") or name.startswith("spectra_"):
            return self.spark.read.parquet(f"{self.path}/{name}")
        raise AttributeError(name)


def ingest(spark: SparkSession, source: DatasetSource, path: str, preprocessors: Sequence[str] = (), scale_on: str | None = None) -> Tables:
    """Reads a source once and writes labels, epochs, preprocessed spectra, subjects, folds and scaling statistics.

    ``scale_on``: a split whose subjects alone give the statistics; all subjects by default."""
    records = source.records(spark)
    source.staging = f"{path}/staging-{uuid.uuid4().hex}"
    epochs, labels = source.read(spark, records)
    name = F.lit(source.name)
    own = labels.join(epochs.select("subject_id", "epoch_idx").distinct(), ["subject_id", "epoch_idx"], "left_semi")
    sinks.write_labels(own.select(name.alias("dataset"), "subject_id", "epoch_idx", "stage"), f"{path}/labels")
    labels = spark.read.parquet(f"{path}/labels").where(F.col("dataset") == source.name)
    kept = epochs.join(labels.select("subject_id", "epoch_idx"), ["subject_id", "epoch_idx"], "left_semi")
    sinks.write_epochs(kept.select(name.alias("dataset"), "subject_id", "epoch_idx", "channel", "samples"), f"{path}/epochs")
    store.remove(spark, source.staging)
    source.staging = None
    epochs = spark.read.parquet(f"{path}/epochs").where(F.col("dataset") == source.name)
    others = [c for c in records.columns if c not in ("subject_id", "num_windows")]
    named = records.groupBy("subject_id").agg(F.min(F.struct(*others)).alias("_r")).select("subject_id", "_r.*")  # of several recordings, the first
    table = sequences.subject_table(labels).join(named, "subject_id", "left")
    sinks.write_table(source.customise(table).withColumn("dataset", name), f"{path}/subjects", "dataset")
    own_folds = source.folds(table)
    folds.rewrite(spark, path, own_folds.select(name.alias("dataset"), "subject_id", "fold", "split"))
    of = epochs if scale_on is None else epochs.join(own_folds.where((F.col("split") == scale_on) & (F.col("fold") == 0)).select("subject_id"), "subject_id", "left_semi")
    stats = scaling.positional_scaling(of, "samples", ["channel"]).withColumn("prep", F.lit("raw"))
    for prep in preprocessors:
        spectra = epochs.select("dataset", "subject_id", "epoch_idx", "channel", PREPROCESSORS[prep](F.col("samples")).alias("spec"))
        sinks.write_table(spectra, f"{path}/spectra_{prep}", "dataset", sort=("subject_id", "epoch_idx"))
        spectra = spark.read.parquet(f"{path}/spectra_{prep}").where(F.col("dataset") == source.name)
        if scale_on is not None:
            spectra = spectra.join(of.select("subject_id").distinct(), "subject_id", "left_semi")
        flat = spectra.select("channel", F.flatten("spec").alias("spec"))
        stats = stats.unionByName(scaling.positional_scaling(flat, "spec", ["channel"]).withColumn("prep", F.lit(prep)))
    sinks.write_table(stats.withColumn("dataset", name), f"{path}/scaling", "dataset")
    return Tables(spark, path)


@dataclass
class EpochDataset:
    """Data sets as sequences of epochs with a split. Heavy arrays are joined to the keys last."""

    tables: Tables
    datasets: Sequence[str]
    selected_channels: Sequence[str] = ("EEG",)
    sequence_length: int = schema.SEQUENCE_LENGTH
    prep: str = "raw"
    fold: int = 0
    target: Callable[[Column], Column] | None = None
    _key: tuple[str, ...] = field(default=("dataset", "subject_id"), repr=False)

    def labels(self) -> DataFrame:
        return self.tables.labels.where(F.col("dataset").isin(*self.datasets)).withColumn("record", F.concat_ws("/", "dataset", F.col("subject_id").cast("string")))

    def split(self, name: str) -> DataFrame:
        """(dataset, subject_id) of a split in this fold. A negative fold is one seeded draw for the whole data set."""
        own = self.tables.folds.where(F.col("dataset").isin(*self.datasets))
        if self.fold >= 0:
            return own.where((F.col("fold") == self.fold) & (F.col("split") == name)).select(*self._key)
        drawn = own.groupBy("dataset").agg(F.min_by("fold", F.xxhash64("dataset", "fold", F.lit(self.fold))).alias("_f"))
        return own.join(F.broadcast(drawn), "dataset").where((F.col("fold") == F.col("_f")) & (F.col("split") == name)).select(*self._key)

    def folds(self) -> int:
        """Folds that every data set has, at most 100."""
        n = self.tables.folds.where(F.col("dataset").isin(*self.datasets)).groupBy("dataset").agg(F.countDistinct("fold").alias("n"))
        return n.agg(F.least(F.min("n"), F.lit(100))).first()[0]

    def sequences(self, split: str) -> DataFrame:
        """(record, rel_idx, stages): training sequences of stride 1, with the target transform if there is one."""
        own = self.labels().join(self.split(split), list(self._key), "left_semi")
        rows = sequences.sequences(own, self.sequence_length, "record")
        out = rows.groupBy("record", "rel_idx").agg(F.array_sort(F.collect_list(F.struct("off", "stage"))).alias("s")).select("record", "rel_idx", F.transform("s", lambda x: x["stage"]).alias("stages"))
        return out if self.target is None else out.withColumn("y", self.target(F.col("stages")))

    def samples(self, split: str) -> DataFrame:
        """(record, rel_idx, stages, x): training sequences with their epochs, x[epoch][channel][sample]. Positions beyond the
        record are zeros, standardised like the rest. Each epoch is shuffled once, as it is stored."""
        stats = {(r["dataset"], r["channel"]): (np.array(r["mean"]), np.array(r["std"])) for r in self.statistics().collect()}
        if missing := [c for c in self.selected_channels if (self.datasets[0], c) not in stats]:
            raise KeyError(f"no scaling statistics of {self.datasets[0]} for {', '.join(missing)}")
        pad = np.stack([gather.standard(np.zeros(len(mean)), mean, std) for mean, std in (stats[self.datasets[0], c] for c in self.selected_channels)])
        places = self.tables.spark.createDataFrame([(*key, i) for i, key in enumerate(stats)], "dataset string, channel string, stat int")
        labels = self.labels().join(self.split(split), list(self._key), "left_semi").select("record", "epoch_idx", "stage")
        own = self.stored_signal(split).join(F.broadcast(places), ["dataset", "channel"]).withColumn("record", F.concat_ws("/", "dataset", F.col("subject_id").cast("string")))  # a row for each data set and channel
        out = gather.samples(labels, own, list(stats.values()), pad, self.sequence_length, len(self.selected_channels), schema.PAD_STAGE)
        return out if self.target is None else out.withColumn("y", self.target(F.col("stages")))

    def statistics(self) -> DataFrame:
        """(dataset, channel, mean, std) of the chosen channels; a row for each, as long as an epoch."""
        own = self.tables.scaling.where((F.col("prep") == self.prep) & F.col("dataset").isin(*self.datasets) & F.col("channel").isin(*self.selected_channels))
        return scaling.packed(own, ["dataset", "channel"])

    def night_samples(self, split: str) -> DataFrame:
        """(record, stages, x): whole records for validation and test, one row each."""
        rows = self.labels().join(self.split(split), list(self._key), "left_semi").select("record", "epoch_idx", "stage").join(self.wide(split), ["record", "epoch_idx"])
        out = rows.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("epoch_idx", "stage", "x"))).alias("s"))
        return out.select("record", F.transform("s", lambda e: e["stage"]).alias("stages"), F.transform("s", lambda e: e["x"]).alias("x"))

    def loaders(self) -> dict[str, DataFrame]:
        """What a training run reads: sequences to train on, whole nights to validate and test on."""
        return {"train": self.samples("train"), "valid": self.night_samples("valid"), "test": self.night_samples("test")}

    def wide(self, split: str) -> DataFrame:
        """(record, epoch_idx, x): an epoch's standardised channels in the caller's order; epochs without all of them are left out."""
        own = self.signal(split).withColumn("record", F.concat_ws("/", "dataset", F.col("subject_id").cast("string")))
        rows = own.groupBy("record", "epoch_idx").agg(F.array_sort(F.collect_list(F.struct("channel_idx", "samples"))).alias("c"))
        return rows.where(F.size("c") == len(self.selected_channels)).select("record", F.col("epoch_idx").cast("int").alias("epoch_idx"), F.transform("c", lambda e: e["samples"]).alias("x"))

    def nights(self, split: str) -> DataFrame:
        return sequences.whole_records(self.labels().join(self.split(split), list(self._key), "left_semi"), "record")

    def signal(self, split: str) -> DataFrame:
        """Standardised epochs of the chosen channels, in the caller's order: samples, or a preprocessor's spectra as one array."""
        return self.stored_signal(split).join(F.broadcast(self.statistics()), ["dataset", "channel"]).withColumn("samples", scaling.standardised(F.col("samples"), F.col("mean"), F.col("std"))).drop("mean", "std")

    def stored_signal(self, split: str) -> DataFrame:
        """The same before standardisation."""
        if self.prep == "raw" and self.tables.bundle is not None:
            epochs = sinks.read_bundle(self.tables.spark, self.tables.bundle, split).drop("split")
        elif self.prep == "raw":
            epochs = self.tables.epochs
        else:
            epochs = getattr(self.tables, f"spectra_{self.prep}").withColumn("samples", F.flatten("spec")).drop("spec")
        return channels.select_channels(epochs.where(F.col("dataset").isin(*self.datasets)), self.selected_channels).join(self.split(split), list(self._key), "left_semi")

    def examples(self, split: str, features: Callable[[Column], Column], context: int = 1) -> DataFrame:
        """(dataset, record, epoch_idx, x, y): for each labelled epoch the features of all its channels, those of the ``context``
        epochs around it in a row, zeros beyond the record. ``features`` makes a small array from an epoch's samples."""
        own = self.signal(split).withColumn("record", F.concat_ws("/", "dataset", F.col("subject_id").cast("string")))
        small = own.select("dataset", "record", F.col("epoch_idx").cast("int").alias("epoch_idx"), "channel_idx", features(F.col("samples")).cast("array<double>").alias("f"))
        wide = small.groupBy("dataset", "record", "epoch_idx").agg(F.array_sort(F.collect_list(F.struct("channel_idx", "f"))).alias("c"))
        wide = wide.where(F.size("c") == len(self.selected_channels)).select("dataset", "record", "epoch_idx", F.flatten(F.transform("c", lambda e: e["f"])).alias("f"))
        labels = self.labels().select("record", F.col("epoch_idx").cast("int").alias("epoch_idx"), F.col("stage").cast("int").alias("y"))
        rows = wide.join(labels, ["record", "epoch_idx"])
        w = Window.partitionBy("dataset", "record").orderBy("epoch_idx")
        none = F.transform("f", lambda v: F.lit(0.0))
        around = [F.coalesce(F.lag("f", -o).over(w), none) for o in range(-(context // 2), context - context // 2)]
        return rows.select("dataset", "record", "epoch_idx", F.concat(*around).alias("x"), "y")


def zipped(split: str, **views: EpochDataset) -> DataFrame:
    """(record, rel_idx, stages, one column of samples for each view): the same sequences under several preprocessings."""
    out = None
    for name, view in views.items():
        own = view.samples(split).withColumnRenamed("x", name)
        out = own if out is None else out.join(own.drop("stages", "y"), ["record", "rel_idx"])
    return out


def evaluate(preds: DataFrame, by: Sequence[str] = ("dataset",), y: str = "y", p: str = "p", record: str = "subject_id") -> DataFrame:
    """One row for each data set: metrics of each record, averaged, next to the pooled ones."""
    each = metrics.classification(preds, [*by, record], y, p)
    mean = each.groupBy(*by).agg(F.count("*").alias("records"), *[F.avg(m).alias(m) for m in metrics.METRICS])
    pooled = metrics.classification(preds, list(by), y, p)
    return mean.join(pooled.select(*by, *[F.col(m).alias(f"pooled_{m}") for m in metrics.METRICS]), list(by)) if by else mean.crossJoin(pooled.select(*[F.col(m).alias(f"pooled_{m}") for m in metrics.METRICS]))


def network(spec: str, n_features: int, n_scores: int, loss: str = "cel", **options) -> object:
    """A model to train: ``dense:32,16`` with hidden layers of these sizes, ``linear``, or ``module:Class`` of one's own, which
    is called with the same arguments as nets.Dense."""
    kind, _, rest = spec.partition(":")
    if kind in ("linear", "dense"):
        hidden = [int(h) for h in rest.split(",") if h]
        return nets.Dense((n_features, *hidden, n_scores), loss=loss, **options)
    return imported(spec)((n_features, n_scores), loss=loss, **options)


def train(data: EpochDataset, path: str, features: Callable[[Column], Column], model: str = "linear", context: int = 1, classes: int = 5, settings: loop.Settings | None = None, params: np.ndarray | None = None, resume: bool = True, loss: str = "cel") -> loop.Fitted:
    """Trains a model on a data set's training split and validates it on the validation split; ``path`` is the run's folder."""
    examples, valid = (data.examples(s, features, context) for s in ("train", "valid"))
    first = examples.where(F.col("x").isNotNull()).select(F.size("x")).first()
    if first is None:
        raise ValueError("no training examples")
    net = network(model, first[0], classes if loss == "cel" else 1, loss)
    return loop.fit(examples, valid, net, path, settings, params, resume)


def finetune(data: EpochDataset, start: str, path: str, features: Callable[[Column], Column], learning_rate: float = 1e-7, weight_decay: float | None = None, settings: loop.Settings | None = None, **more) -> loop.Fitted:
    """As train(), from the best parameters of another run, with a rate of its own; the decay is the rate unless given."""
    own = loop.Settings(**(dataclasses.asdict(settings or loop.Settings()) | {"learning_rate": learning_rate, "weight_decay": learning_rate if weight_decay is None else weight_decay}))
    return train(data, path, features, settings=own, params=loop.checkpoint(data.tables.spark, start), resume=False, **more)


def test_model(data: Sequence[EpochDataset], fitted: loop.Fitted, features: Callable[[Column], Column], context: int = 1, results: str | None = None, aggregate: bool = False) -> DataFrame:
    """Loss and metrics on the test splits, a row for each data set or one for all together; written as one CSV if asked for."""
    rows = None
    for d in data:
        own = d.examples("test", features, context)
        rows = own if rows is None else rows.unionByName(own)
    out = loop.test(rows, fitted.model, fitted.params, () if aggregate else ("dataset",))
    out = out.withColumn("dataset", F.lit("aggregate")) if aggregate else out
    if results is not None:
        sinks.write_report(out, results)
    return out


def mean_loss(preds: DataFrame, loss: str = "cel", y: str = "y", p: str = "p") -> DataFrame:
    return preds.agg(F.avg(LOSSES[loss](F.col(y), F.col(p))).alias("loss"))


def prototype_report(rows: DataFrame, codes: int, classes: int = 5, record: str = "subject_id") -> dict[str, DataFrame]:
    """The tables of a prototype analysis: rows are (record, epoch_idx, code, stage)."""
    return {
        "specificity": prototypes.specificity(rows, range(classes)),
        "sensitivity": prototypes.sensitivity(rows, codes),
        "percentages": prototypes.percentages(rows),
        "transitions": prototypes.transitions(rows, codes, record, "code"),
        "density": prototypes.shares_within(rows, "code", record),
    }


def load_model(spark: SparkSession, name: str, sequence_length: int, in_channels: int, models_: dict[str, Callable[..., models.Model]] | None = None) -> models.Model | str:
    """A registered model: what fits or reads it, or its checkpoint's name where ``models_`` has none; fails where there is none."""
    found = models.lookup(models.registry(spark), name, sequence_length, in_channels).select("checkpoint").head(1)
    if not found:
        raise KeyError(f"no model {name} for {sequence_length} epochs and {in_channels} channels")
    make = (models_ or {}).get(name)
    return found[0][0] if make is None else make(found[0][0])


def preprocess(spark: SparkSession, args: argparse.Namespace) -> Tables:
    """Ingests a data set by name, or by the class that --source names. Options of a YAML file come before those given here."""
    from nightloom.sources import datasets

    options = {"dataset": args.dataset, "data_folder": args.data_folder, "output": args.output, "source": args.source, "preprocessors": args.preprocessors, "source_kwargs": {}}
    if args.config is not None:
        import yaml

        with open(args.config, encoding="utf-8") as f:
            options |= yaml.safe_load(f) or {}
    kind = datasets.SOURCES.get(options["dataset"]) if options["source"] is None else imported(options["source"])
    if kind is None:
        raise KeyError(f"no data set {options['dataset']}; there are {', '.join(sorted(datasets.SOURCES))}")
    names = []
    for spec in options["preprocessors"] or ():
        name = spec.partition(":")[2] or spec
        if ":" in spec:
            register_preprocessor(name, imported(spec))
        names.append(name)
    return ingest(spark, kind(options["data_folder"], **options["source_kwargs"]), options["output"], names)


def compress(spark: SparkSession, path: str, output: str, fold: int = 0, half: Sequence[str] = ("shhs",)) -> None:
    """Bundles of all data sets' epochs by split; those of the data sets named in ``half`` in half precision."""
    tables = Tables(spark, path)
    sinks.write_bundle(tables.epochs, tables.folds, output, fold=fold, half=half)


def main(argv: Sequence[str] | None = None) -> None:
    """Command line: ingest a data set, bundle it, evaluate a table of predictions, or look a model up."""
    parser = argparse.ArgumentParser(prog="nightloom")
    commands = parser.add_subparsers(dest="command", required=True)
    take = commands.add_parser("preprocess", help="ingest a data set")
    take.add_argument("-d", "--dataset")
    take.add_argument("-df", "--data-folder", dest="data_folder")
    take.add_argument("-o", "--output")
    take.add_argument("-s", "--source", help="module:Class of a source of one's own")
    take.add_argument("-p", "--preprocessors", nargs="*", default=(), help="names, or module:function")
    take.add_argument("-c", "--config", help="YAML file with these options and source_kwargs")
    pack = commands.add_parser("compress", help="bundles by split")
    pack.add_argument("tables")
    pack.add_argument("output")
    pack.add_argument("--fold", type=int, default=0)
    pack.add_argument("--half", nargs="*", default=("shhs",))
    for command, what in (("train", "train a model on ingested data sets"), ("finetune", "go on from another run's best checkpoint")):
        fit = commands.add_parser(command, help=what)
        fit.add_argument("tables")
        fit.add_argument("checkpoint", help="folder of the run")
        fit.add_argument("-d", "--datasets", nargs="+", required=True)
        fit.add_argument("-x", "--features", default="nightloom.training.features:log_band_powers", help="module:function of an epoch's samples")
        fit.add_argument("-m", "--model", default="linear", help="linear, dense:32,16 or module:Class")
        fit.add_argument("--channels", nargs="+", default=("EEG",))
        fit.add_argument("--context", type=int, default=1)
        fit.add_argument("--fold", type=int, default=0)
        fit.add_argument("--epochs", type=int, default=10)
        fit.add_argument("--batch-rows", type=int, default=4096)
        fit.add_argument("--learning-rate", type=float, default=1e-3 if command == "train" else 1e-7)
        fit.add_argument("--weight-decay", type=float, default=0.0 if command == "train" else None)
        fit.add_argument("--monitor", default="val_acc")
        fit.add_argument("--mode", default="max", choices=("max", "min"))
        fit.add_argument("--results", help="CSV of the tests, after training")
        fit.add_argument("--bundle", help="read epochs from this bundle of compress")
        if command == "finetune":
            fit.add_argument("--start", required=True, help="folder of the run to go on from")
    test = commands.add_parser("test", help="metrics of a Parquet table (dataset, subject_id, y, p)")
    test.add_argument("predictions")
    test.add_argument("--results", required=True)
    test.add_argument("--aggregate", action="store_true", help="one row for all data sets")
    find = commands.add_parser("model", help="a model's checkpoint")
    find.add_argument("name")
    find.add_argument("--sequence-length", type=int, default=schema.SEQUENCE_LENGTH)
    find.add_argument("--in-channels", type=int, default=1)
    args = parser.parse_args(argv)
    from nightloom.session import session

    spark = session()
    if args.command == "preprocess":
        preprocess(spark, args)
    elif args.command == "compress":
        compress(spark, args.tables, args.output, args.fold, args.half)
    elif args.command in ("train", "finetune"):
        data = EpochDataset(Tables(spark, args.tables, args.bundle), args.datasets, args.channels, fold=args.fold)
        features, more = imported(args.features), {"model": args.model, "context": args.context}
        settings = loop.Settings(learning_rate=args.learning_rate, weight_decay=args.weight_decay or 0.0, batch_rows=args.batch_rows, epochs=args.epochs, monitor=args.monitor, mode=args.mode)
        if args.command == "train":
            fitted = train(data, args.checkpoint, features, settings=settings, **more)
        else:
            fitted = finetune(data, args.start, args.checkpoint, features, args.learning_rate, args.weight_decay, settings, **more)
        if args.results:
            test_model([data], fitted, features, args.context, args.results)
    elif args.command == "test":
        preds = spark.read.parquet(args.predictions)
        sinks.write_report(evaluate(preds, () if args.aggregate else ("dataset",)), args.results)
    else:
        print(load_model(spark, args.name, args.sequence_length, args.in_channels))


if __name__ == "__main__":
    main()
