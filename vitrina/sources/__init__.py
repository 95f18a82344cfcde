from .almacen import Almacen, Medida
from .diaria import TablaDiaria
from .estrella import FuenteEstrella
from .mart import Mart
from .tablas import Fuente, FuenteTablas

__all__ = ["Almacen", "Fuente", "FuenteEstrella", "FuenteTablas", "Mart", "Medida", "TablaDiaria"]
