from .exportar import exportar, registrar_tiempos

__all__ = ["exportar", "registrar_tiempos"]
