"""Saving a trained model and reading it back."""

from __future__ import annotations

from pyspark.ml import PipelineModel


def model_file_name(name: str) -> str:
    """Fixed value: the name of a saved model's file."""
    return f"{name.replace(' ', '_').lower()}_trained_model"


def save_model(model: PipelineModel, name: str, folder: str) -> str:
    """Write the model below ``folder`` (any file system Spark can reach) and return its path."""
    path = f"{folder.rstrip('/')}/{model_file_name(name)}"
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
