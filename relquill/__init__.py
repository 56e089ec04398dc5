"""relquill: entity queries over DataFrames, by method name or by object query text.

``Engine(spark)`` opens workspaces; a workspace holds entity tables as immutable
DataFrame versions; a repository compiles a method name or a query text once and
lowers it to DataFrame operations that Catalyst optimizes.
"""

from relquill.engine import Engine
from relquill.functions.values import Converter, TypeHandler, register_type
from relquill.plans.schema import Entity, Field, InverseOne, ManyToMany, ToMany, ToOne
from relquill.repository import Repository
from relquill.sources.workspace import Workspace

__all__ = ["Converter", "Engine", "Entity", "Field", "InverseOne", "ManyToMany", "Repository", "ToMany", "ToOne", "TypeHandler", "Workspace", "register_type"]
