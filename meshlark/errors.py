"""Exceptions. Everything raised on purpose is a GridError."""


class GridError(Exception):
    pass


class ContractError(GridError, ValueError):
    """An argument, a column or a document breaks its contract."""


class DatasetError(ContractError):
    pass


class ManifestError(DatasetError):
    pass


class CompactSetError(ContractError):
    pass


class TimeCubeError(ContractError):
    pass


class UnknownDomainError(GridError, KeyError):
    pass


class CandidateLimitError(ContractError):
    pass


class DependencyError(GridError, ImportError):
    pass
